"""The same results in plain SQL over the same tables, written independently."""

from __future__ import annotations

from ..functions import constants as K
from . import views
from .queries import MARKOV_ORDER, MIRNA, PSSM_ABOVE, PSSM_INFORMATION, SIMILAR, TISSUE, WORD

ORACLE: dict[str, str] = {}

DOCS = """docs AS (SELECT doc_id, source, 'D' || doc_id || ' ' || source AS header,
  upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"""
BENCH = """bench AS (SELECT item_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq
  FROM benchmark)"""


def proteins(name: str, source: str, key: str) -> str:
    """CTE with the codon translation of a CTE."""
    base = ["instr('%s', substring(seq, i + %d, 1)) - 1" % (K.CODON_BASES, n) for n in range(3)]
    index = f"16 * ({base[0]}) + 4 * ({base[1]}) + ({base[2]}) + 1"
    return f"""{name} AS (
  SELECT s.{key}, coalesce(p.seq, '') AS seq FROM {source} s LEFT JOIN (
    SELECT {key}, string_agg(nullif(substring('{K.CODON_RESIDUES}', {index}, 1), '{K.STOP}'), '' ORDER BY i) AS seq
    FROM (SELECT {key}, seq, unnest(range(1, length(seq) - 1, 3)) AS i FROM {source}) GROUP BY {key}
  ) p ON s.{key} = p.{key})"""


def grams(name: str, source: str, key: str, k: int) -> str:
    """CTE (key, position, context, symbol) with shorter contexts at the start."""
    return f"""{name} AS (
  SELECT {key}, i AS position, substring(seq, greatest(i - {k}, 1), least({k}, i - 1)) AS context,
         substring(seq, i, 1) AS symbol
  FROM (SELECT {key}, seq, unnest(range(1, length(seq) + 1)) AS i FROM {source}))"""


def windows(name: str, source: str, key: str, width: int) -> str:
    return f"""{name} AS (
  SELECT {key}, i AS start, substring(seq, i + 1, {width}) AS w
  FROM (SELECT {key}, seq, unnest(range(0, length(seq) - {width} + 1)) AS i FROM {source}))"""


# --- relational support -----------------------------------------------------------------

SUPPORT = f"""genes AS (SELECT o_orderkey refseq, o_orderpriority chromosome, o_custkey ch_start,
    o_custkey + 100 ch_end, nullif(o_orderstatus, 'P') description FROM orders),
  expr AS (SELECT c_custkey gene, n_name AS "type", c_mktsegment tissue FROM customer, nation
    WHERE c_nationkey = n_nationkey),
  rws AS (SELECT l_returnflag AS "miRNA", g.refseq, o_custkey AS unigene, e."type", e.tissue, g.chromosome,
      g.ch_start, g.ch_end, g.description, l_suppkey AS tool
    FROM genes g, expr e, lineitem l, orders o
    WHERE o.o_custkey = e.gene AND o.o_orderkey = l.l_orderkey AND o.o_orderkey = g.refseq
      AND l_returnflag = '{MIRNA}' AND e.tissue = '{TISSUE}')"""
ORACLE["support_rows"] = f"WITH {SUPPORT} SELECT * FROM rws"
REPORT = """rpt AS (SELECT "miRNA", refseq AS gene, max(unigene) unigene, max("type") AS "type",
    max(tissue) tissue, max(chromosome) chromosome, max(ch_start) ch_start, max(ch_end) ch_end,
    max(coalesce(description, 'NULL')) description, count(DISTINCT tool) tool_count
  FROM rws GROUP BY ALL HAVING count(DISTINCT tool) >= 3 ORDER BY tool_count DESC, gene LIMIT 10)"""
REPORT = REPORT.replace("GROUP BY ALL", 'GROUP BY "miRNA", refseq')
ORACLE["support_join"] = f"WITH {SUPPORT}, {REPORT} SELECT * FROM rpt"
TOOLS = "tools AS (SELECT DISTINCT gene, tool_count, tool FROM rpt JOIN rws ON rpt.gene = rws.refseq)"
ORACLE["support_tools"] = f"WITH {SUPPORT}, {REPORT}, {TOOLS} SELECT * FROM tools"
ORACLE["write_support"] = f"""WITH {SUPPORT}, {REPORT}, {TOOLS},
  listed AS (SELECT gene, string_agg(tool || ', ', '' ORDER BY tool::VARCHAR) t FROM tools GROUP BY gene),
  txt AS (SELECT concat_ws(chr(9), "miRNA", gene, unigene, "type", tissue, chromosome, ch_start, ch_end, description) a,
    'Tools: ' || t || chr(9) || 'Tool Count: ' || tool_count b,
    3 * (row_number() OVER (ORDER BY tool_count DESC, gene) - 1) n FROM rpt JOIN listed USING (gene))
  SELECT n + 1 AS line, a AS value FROM txt UNION ALL SELECT n + 2, b FROM txt UNION ALL SELECT n + 3, '' FROM txt"""
ORACLE["write_support_rows"] = f"""WITH {SUPPORT} SELECT array_to_string([coalesce(x, '') for x in ["miRNA", refseq::VARCHAR,
    unigene::VARCHAR, "type", tissue, chromosome, ch_start::VARCHAR, ch_end::VARCHAR, description, tool::VARCHAR]],
    chr(9)) AS value FROM rws"""

# --- profiles and statistics ------------------------------------------------------------


def profile(group: str, ident: str, order: str, source: str) -> str:
    return f"""SELECT {group}, count(*) n_total, count(*) FILTER (value <> 0) n_nonzero,
    min(value) FILTER (value <> 0) min_value, max(value) FILTER (value <> 0) max_value,
    round(avg(value) FILTER (value <> 0), 6) avg_value,
    first({ident} ORDER BY value, {order}) FILTER (value <> 0) min_id,
    first({ident} ORDER BY value DESC, {order}) FILTER (value <> 0) max_id
  FROM {source} GROUP BY {group}"""


ZEROED = """(SELECT event_id, event_type, user_id, CASE WHEN value < 1 THEN 0 ELSE value END AS value
  FROM events) z"""
ORACLE["group_profile"] = profile("event_type", "user_id", "event_id", ZEROED)
ORACLE["write_table"] = f"""WITH p AS ({ORACLE['group_profile']})
  SELECT 1 + row_number() OVER (ORDER BY event_type) AS line, concat_ws(chr(9), event_type, n_total, n_nonzero, min_value,
    max_value, format('{{:.4f}}', avg_value), min_id, max_id) AS value FROM p
  UNION ALL SELECT 1, concat_ws(chr(9), 'event_type', 'n_total', 'n_nonzero', 'min_value', 'max_value', 'avg_value',
    'min_id', 'max_id')"""
ORACLE["fill_forward"] = """SELECT event_id, event_type, last_value(mark IGNORE NULLS) OVER (
    PARTITION BY event_type ORDER BY event_id) AS mark
  FROM (SELECT event_id, event_type, CASE WHEN value > 50 THEN value END AS mark FROM events)"""
GC = "length(regexp_replace(seq, '[^GC]', '', 'g'))"
STATS = f"""st AS (SELECT source, count(*) n, sum(length(seq))::BIGINT total_length, min(length(seq)) min_length,
    max(length(seq)) max_length, round(avg(length(seq)), 6) avg_length, sum({GC})::BIGINT gc_total,
    round(100.0 * sum({GC}) / sum(length(seq)), 6) gc_percent FROM docs GROUP BY source)"""
ORACLE["contig_stats"] = f"""WITH {DOCS}, {STATS} SELECT source, n, total_length, min_length::INTEGER min_length,
  max_length::INTEGER max_length, avg_length, gc_total, gc_percent FROM st"""
N50 = """ordered AS (SELECT source, length(seq) AS len,
    sum(length(seq)) OVER (PARTITION BY source ORDER BY length(seq) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum,
    sum(length(seq)) OVER (PARTITION BY source) AS tot FROM docs),
  n5 AS (SELECT source, count(*) n50_count, min(len) n50, round(avg(len), 6) n50_avg FROM ordered
    WHERE cum - len < tot / 2.0 GROUP BY source)"""
ORACLE["n50_stats"] = f"WITH {DOCS}, {N50} SELECT source, n50_count, n50, n50_avg FROM n5"
BOTH = f"""both_ AS (SELECT source AS file, n, total_length, min_length::INTEGER min_length,
  max_length::INTEGER max_length, avg_length, gc_total, gc_percent, n50_count, n50, n50_avg
  FROM st JOIN n5 USING (source))"""
ORACLE["assembly_statistics"] = f"WITH {DOCS}, {STATS}, {N50}, {BOTH} SELECT * FROM both_"
ORACLE["folder_statistics"] = ORACLE["assembly_statistics"]
ORACLE["write_statistics"] = f"""WITH {DOCS}, {STATS}, {N50}, {BOTH}
  SELECT file, unnest(['No of Sequences = ' || n, 'Total Sequence Length = ' || total_length,
    'GC Total = ' || gc_total, format('GC Perc = {{:.3f}}', gc_percent), format('Avg Contig Size = {{:.3f}}', avg_length),
    'Min Contig Size = ' || min_length, 'Max Contig Size = ' || max_length, 'Total N50 contigs = ' || n50_count,
    'N50ContigSize = ' || n50, format('N50Avg = {{:.3f}}', n50_avg)]) AS value FROM both_"""

# --- hits -------------------------------------------------------------------------------

ORACLE["best_hits"] = """WITH h AS (SELECT user_id AS contig, event_type AS gene,
    arg_max(value, event_id) AS evalue FROM events GROUP BY 1, 2),
  t AS (SELECT event_type AS gene, arg_max(props, event_id) AS description FROM events
    WHERE event_type <> 'error' GROUP BY 1)
  SELECT contig, h.gene, description, evalue FROM h LEFT JOIN t USING (gene) WHERE evalue < 20"""
ORACLE["write_best_hits"] = f"""WITH b AS ({ORACLE['best_hits']})
  SELECT row_number() OVER (ORDER BY contig, gene) AS line,
    array_to_string([contig::VARCHAR, gene, coalesce(description, ''), format('{{:.4f}}', evalue)], chr(9)) AS value FROM b"""
MULTI = """m AS (SELECT event_type AS gene, count(*) FILTER (value < 5) AS n_below FROM events GROUP BY 1),
  mc AS (SELECT event_type AS gene, n_below, user_id AS contig, arg_max(value, event_id) AS evalue
    FROM events JOIN m ON event_type = gene WHERE n_below > 1 GROUP BY ALL)"""
MULTI = MULTI.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")
ORACLE["multi_contig_hits"] = f"WITH {MULTI} SELECT * FROM mc"
ORACLE["write_multi_contig"] = f"""WITH {MULTI}, n AS (SELECT gene, lpad(contig::VARCHAR, greatest(5, length(contig::VARCHAR))::INTEGER, '0') AS contig,
    format('{{:.4f}}', evalue) AS evalue, row_number() OVER (PARTITION BY gene ORDER BY lpad(contig::VARCHAR, greatest(5, length(contig::VARCHAR))::INTEGER, '0')) AS place FROM mc),
  f AS (SELECT gene, 0 AS place, chr(10) || gene AS value FROM n WHERE place = 1
    UNION ALL SELECT gene, 2 * place - 1, CASE WHEN place = 1 THEN ' ' ELSE '' END || contig FROM n
    UNION ALL SELECT gene, 2 * place, evalue FROM n)
  SELECT row_number() OVER (ORDER BY gene, place) AS field, value FROM f"""
ORACLE["query_hits"] = """SELECT c_custkey AS query, c_name, c_acctbal, o_orderkey, o_totalprice
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey"""
ORACLE["query_nohits"] = """SELECT c_custkey AS query, c_name, c_acctbal FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""

# --- cutting ----------------------------------------------------------------------------

REQUESTS = """req AS (SELECT 'D' || doc_id AS id, doc_id % 40 + 1 AS "start",
    doc_id % 40 + 1 + 20 + quality * 30 AS "end" FROM labels)"""
INTERVALS = """cuts AS (SELECT d.doc_id, id, "start", "end", substring(seq, "start", "end" - "start" + 1) AS fragment
  FROM docs d JOIN req ON starts_with(d.header, req.id))"""
ORACLE["read_intervals"] = f"WITH {REQUESTS} SELECT * FROM req"
ORACLE["extract_intervals"] = f"WITH {DOCS}, {REQUESTS}, {INTERVALS} SELECT * FROM cuts"
ORACLE["extract_intervals_pieces"] = ORACLE["extract_intervals"]
ORACLE["write_fasta"] = f"""WITH {DOCS}, {REQUESTS}, {INTERVALS}
  SELECT '>' || id || ' | start=' || "start" || ' | end=' || "end" AS value FROM cuts
  UNION ALL SELECT fragment FROM cuts"""
HITS = """hits AS (SELECT d.source AS file, 'D' || l.doc_id AS id, d.seq,
    CASE WHEN l.doc_id % 2 = 1 THEN l.doc_id % 40 + 61 ELSE l.doc_id % 40 + 1 END AS "start",
    CASE WHEN l.doc_id % 2 = 1 THEN l.doc_id % 40 + 1 ELSE l.doc_id % 40 + 61 END AS "end"
  FROM labels l JOIN docs d USING (doc_id))"""


def hit_cut(reverse: str) -> str:
    return f"""hc AS (SELECT file, id, "start", "end", CASE WHEN "end" > "start"
      THEN substring(seq, "start", "end" - "start" + 1) ELSE {reverse} END AS fragment FROM hits)"""


BACK = 'reverse(substring(seq, "end", "start" - "end" + 1))'
CUT = 'SELECT file, id, length(fragment)::INTEGER AS length, "start", "end", fragment FROM hc'
ORACLE["extract_hits"] = f"WITH {DOCS}, {HITS}, {hit_cut(BACK)} {CUT}"
ORACLE["extract_hits_complemented"] = (
    f"WITH {DOCS}, {HITS}, {hit_cut(f'''translate({BACK}, 'ACGT', 'TGCA')''')} {CUT}")
ORACLE["write_hit_fasta"] = f"""WITH {DOCS}, {HITS}, {hit_cut(BACK)}
  SELECT '>' || concat_ws('|', file, id, length(fragment), "start", "end") AS value FROM hc
  UNION ALL SELECT fragment FROM hc"""
ORACLE["read_bp_hits"] = f"""WITH {DOCS}, {HITS} SELECT id, "start", "end" FROM hits
  UNION ALL SELECT id, "start" + 5, "end" + 5 FROM hits"""

# --- k-grams and Markov models ----------------------------------------------------------

PROTEINS = proteins("prot", "docs", "doc_id")
BENCH_PROTEINS = proteins("bprot", "bench", "item_id")
ORACLE["kgrams"] = f"WITH {BENCH}, {grams('g', 'bench', 'item_id', MARKOV_ORDER)} SELECT * FROM g"
ORACLE["translate_codons"] = f"WITH {DOCS}, {PROTEINS} SELECT doc_id, seq AS protein FROM prot"


def frequencies(name: str, source: str, alphabet: str) -> str:
    return f"""{name} AS (SELECT symbol, n, n / sum(n) OVER () AS frequency FROM (
    SELECT symbol, sum(length(seq) - length(replace(seq, symbol, '')))::BIGINT AS n
    FROM {source}, (SELECT unnest(string_split('{",".join(alphabet)}', ',')) AS symbol) GROUP BY symbol))"""


def model(name: str, source: str) -> str:
    return f"""{name} AS (SELECT context, symbol, count(*) AS n, sum(count(*)) OVER (PARTITION BY context) AS total
    FROM {source} GROUP BY context, symbol)"""


FREQ = frequencies("freq", "docs", K.NUCLEOTIDES)
ORACLE["symbol_frequencies"] = f"""WITH {DOCS}, {FREQ}
  SELECT symbol, n, round(frequency, 9) AS frequency, round(ln(frequency), 9) AS log_p FROM freq"""
ORACLE["distinct_symbols"] = f"""WITH {DOCS}, {PROTEINS} SELECT DISTINCT unnest(string_split(seq, '')) AS symbol
  FROM prot WHERE seq <> ''"""
TRAINED = f"{DOCS}, {grams('g', 'docs', 'doc_id', MARKOV_ORDER)}, {model('m', 'g')}"
ORACLE["markov_train"] = f"WITH {TRAINED} SELECT context, symbol, n FROM m"
ORACLE["load_model"] = ORACLE["markov_train"]
ORACLE["markov_train_protein"] = f"""WITH {DOCS}, {PROTEINS}, {grams('g', 'prot', 'doc_id', 1)}, {model('m', 'g')}
  SELECT context, symbol, n FROM m"""
ORACLE["markov_logq"] = f"""WITH {TRAINED} SELECT context, symbol, n, total::BIGINT AS total,
  round(ln(n / total), 9) AS log_q FROM m"""
ORACLE["model_stats"] = f"""WITH {TRAINED} SELECT max(length(context))::INTEGER AS model_order,
  (sum(n) FILTER (context = ''))::BIGINT AS n_sequences, count(*) + count(DISTINCT context) AS n_keys,
  sum(n)::BIGINT AS n_instances FROM m"""
WIDTH = MARKOV_ORDER + 1
ORACLE["dump_model"] = f"""WITH {TRAINED}
  SELECT lpad(context || symbol, {WIDTH}, chr(1)) || repeat(' ', 12) || n AS line FROM m
  UNION ALL SELECT repeat('-', {WIDTH + 13}) || ' ' || sum(n)::BIGINT FROM m GROUP BY context"""
ORACLE["write_dump"] = f"""WITH {TRAINED}, l AS (
    SELECT lpad(context || symbol, {WIDTH}, chr(1)) AS key, lpad(context || symbol, {WIDTH}, chr(1)) || repeat(' ', 12) || n AS value FROM m
    UNION ALL SELECT lpad(context || chr(255), {WIDTH}, chr(1)), repeat('-', {WIDTH + 13}) || ' ' || sum(n)::BIGINT FROM m GROUP BY context)
  SELECT row_number() OVER (ORDER BY key) AS line, value FROM l"""


def scored(seqs: str, key: str, train: str, train_key: str, k: int, alphabet: str) -> str:
    return f"""{grams('tg', train, train_key, k)}, {model('m', 'tg')}, {frequencies('freq', seqs, alphabet)},
  {grams('sg', seqs, key, k)},
  w AS (SELECT {key}, coalesce(ln(m.n / m.total), {K.UNSEEN_LOG_Q}) - coalesce(ln(nullif(frequency, 0)), 0) AS w
    FROM sg LEFT JOIN m ON sg.context = m.context AND sg.symbol = m.symbol LEFT JOIN freq ON sg.symbol = freq.symbol)
  SELECT s.{key}, round(coalesce(sum(w), 0), 6) AS score FROM {seqs} s LEFT JOIN w ON s.{key} = w.{key} GROUP BY s.{key}"""


ORACLE["markov_score"] = (
    f"WITH {DOCS}, {BENCH}, {scored('docs', 'doc_id', 'bench', 'item_id', MARKOV_ORDER, K.NUCLEOTIDES)}")
ORACLE["markov_score_pieces"] = ORACLE["markov_score"]
ORACLE["markov_score_protein"] = (
    f"WITH {DOCS}, {BENCH}, {PROTEINS}, {BENCH_PROTEINS}, "
    f"{scored('prot', 'doc_id', 'bprot', 'item_id', 1, K.AMINO_ACIDS)}")

# --- headers ----------------------------------------------------------------------------

ORACLE["parse_orf_header"] = """SELECT o_orderkey, 'orf' || o_orderkey AS name, o_orderkey AS length, o_custkey AS "start",
  CASE WHEN o_orderkey % 2 = 0 THEN '<-' ELSE '->' END AS strand,
  CASE WHEN o_orderstatus = 'F' THEN '3e-' || o_custkey ELSE 'none' END AS orth_eval,
  o_orderpriority AS description FROM orders"""
ORACLE["parse_contig_header"] = f"""WITH {DOCS} SELECT 'ctg' || doc_id % 50 AS contig, count(*) AS n,
  sum(length(seq))::BIGINT AS total_length, sum({GC})::BIGINT AS gc_total FROM docs GROUP BY 1"""
ORACLE["parse_protein_header"] = """SELECT p_partkey, 'P' || p_partkey AS accession, p_name AS description,
  replace(p_brand, '#', 'g') AS gene FROM part"""

# --- position weights -------------------------------------------------------------------

COUNTS = """motifs AS (SELECT translate(strftime(o_orderdate, '%Y%m%d'), '0123456789', 'ACGTACGTAC') AS motif,
    o_orderkey FROM orders),
  c AS (SELECT p::INTEGER AS position, substring(motif, p + 1, 1) AS symbol, count(*) AS n
    FROM (SELECT motif, unnest(range(0, 8)) AS p FROM motifs) GROUP BY 1, 2)"""
INFO = """info AS (SELECT position, 2 + sum(n / t * log2(n / t)) AS information
    FROM (SELECT *, sum(n) OVER (PARTITION BY position) AS t FROM c) GROUP BY position)"""
BACKGROUND = ", ".join(f"('{s}', {p}::DOUBLE)" for s, p in K.BASE_BACKGROUND.items())
ODDS = f"""odds AS (SELECT p.position, b.symbol,
    ln((coalesce(c.n, 0) + {K.PSEUDOCOUNT}::DOUBLE * b.p) / (p.t + {K.PSEUDOCOUNT}::DOUBLE)) - ln(b.p) AS log_odds
  FROM (SELECT position, sum(n) AS t FROM c GROUP BY position) p
  CROSS JOIN (VALUES {BACKGROUND}) b(symbol, p)
  LEFT JOIN c ON c.position = p.position AND c.symbol = b.symbol)"""
ORACLE["read_motifs"] = f"WITH {COUNTS} SELECT o_orderkey AS name, motif FROM motifs"
ORACLE["pssm_counts"] = f"WITH {COUNTS} SELECT * FROM c"
ORACLE["pssm_information"] = f"WITH {COUNTS}, {INFO} SELECT position, round(information, 9) AS information FROM info"
ORACLE["pssm_logodds"] = f"WITH {COUNTS}, {ODDS} SELECT position, symbol, round(log_odds, 9) AS log_odds FROM odds"
SCAN = f"""{DOCS}, {COUNTS}, {INFO}, {ODDS}, {windows('win', 'docs', 'doc_id', 8)},
  used AS (SELECT odds.* FROM odds JOIN info USING (position) WHERE information > {PSSM_INFORMATION}),
  sc AS (SELECT doc_id, start, w AS "window", round(sum(log_odds), 6) AS score
    FROM win JOIN used ON substring(w, position + 1, 1) = symbol GROUP BY doc_id, start, w)"""
ORACLE["pssm_scan"] = f'WITH {SCAN} SELECT doc_id, start, score, "window" FROM sc WHERE score > {PSSM_ABOVE}'
TOP = f"{SCAN}, top AS (SELECT * FROM sc ORDER BY score DESC, start DESC, doc_id LIMIT 10)"
ORACLE["pssm_top_hits"] = f'WITH {TOP} SELECT doc_id, start, score, "window" FROM top'
ORACLE["write_hits"] = f"""WITH {TOP} SELECT row_number() OVER (ORDER BY score DESC, start DESC, 'D' || doc_id) AS line, format('{{:>9s}} {{:6.1f}} {{:6d}} {{}}', 'D' || doc_id, score, start, "window") AS value
  FROM top"""

# --- matrices ---------------------------------------------------------------------------

FLOW = """fl AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*) AS n
    FROM lineitem, orders, customer, supplier
    WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey GROUP BY 1, 2),
  m1 AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS value FROM fl)"""


def times(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT a.i, b.j, sum(a.value * b.value) AS value FROM {a} a JOIN {b} b ON a.j = b.i
    GROUP BY a.i, b.j)"""


ORACLE["matrix_power"] = f"""WITH {FLOW}, {times('m2', 'm1', 'm1')}, {times('m3', 'm2', 'm1')},
  {times('m4', 'm3', 'm1')}, {times('m5', 'm4', 'm1')} SELECT i, j, round(value, 9) AS value FROM m5"""
ORACLE["substitution_scores"] = f"""WITH {FLOW},
  sh AS (SELECT s_nationkey AS i, count(*) / (SELECT count(*) FROM supplier) AS f FROM supplier GROUP BY 1),
  lo AS (SELECT i, j, log10(value / f) AS l FROM m1 JOIN sh USING (i))
  SELECT x.i AS a, x.j AS b, round(10 * (x.l + y.l) / 2)::INTEGER AS score FROM lo x JOIN lo y ON x.i = y.j AND x.j = y.i"""
ORACLE["read_substitutions"] = f"""WITH {FLOW}, ij AS (SELECT a.i, b.i AS j FROM (SELECT DISTINCT i FROM m1) a
    CROSS JOIN (SELECT unnest(range(0, 25)) AS i) b)
  SELECT ij.i, ij.j::INTEGER AS j, round(coalesce(round(value * 10000, 3), 0) * 0.0001, 7) AS value
  FROM ij LEFT JOIN m1 ON ij.i = m1.i AND ij.j = m1.j"""

# --- seeds ------------------------------------------------------------------------------

SEEDS = f"""{DOCS}, {BENCH}, {windows('qw', 'bench', 'item_id', WORD)}, {windows('tw', 'docs', 'doc_id', WORD)},
  seeds AS (SELECT item_id AS q_id, doc_id AS t_id, qw.start AS q_pos, tw.start AS t_pos, qw.w AS word
    FROM qw JOIN tw ON qw.w = tw.w)"""
ORACLE["seed_exact"] = f"WITH {SEEDS} SELECT * FROM seeds"
RUNS = f"""runs AS (SELECT q_id, t_id, min(q_pos) AS q_pos, min(t_pos) AS t_pos, count(*) + {WORD} - 1 AS length
    FROM (SELECT *, q_pos - row_number() OVER (PARTITION BY q_id, t_id, t_pos - q_pos ORDER BY q_pos) AS r FROM seeds)
    GROUP BY q_id, t_id, t_pos - q_pos, r)"""
ORACLE["seed_runs"] = f"WITH {SEEDS}, {RUNS} SELECT * FROM runs"


def extension(name: str, sign: int) -> str:
    """Steps outwards from a run, until the running score is used up; first best step."""
    q = "q_pos + length + o" if sign > 0 else "q_pos + 1 - o"
    t = "t_pos + length + o" if sign > 0 else "t_pos + 1 - o"
    room = ("least(length(b.seq) - q_pos - r.length, length(d.seq) - t_pos - r.length)" if sign > 0
            else "least(q_pos, t_pos)")
    return f"""{name}_s AS (SELECT rid, o, r.length + sum(CASE WHEN same THEN {K.MATCH} ELSE -{K.MISMATCH} END)
      OVER (PARTITION BY rid ORDER BY o) AS cum, r.length AS start_score
    FROM (SELECT rid, r.length, o, substring(qs, {q.replace('length', 'r.length')}, 1) = substring(ts, {t.replace('length', 'r.length')}, 1) AS same
      FROM (SELECT r.*, b.seq AS qs, d.seq AS ts, unnest(range(1, {room} + 1)) AS o
        FROM numbered r JOIN bench b ON item_id = q_id JOIN docs d ON doc_id = t_id) r) r),
  {name}_a AS (SELECT rid, o, cum, start_score, min(cum) OVER (PARTITION BY rid ORDER BY o) > 0 AS alive FROM {name}_s),
  {name} AS (SELECT rid, first(o ORDER BY cum DESC, o) AS at, max(cum) AS best
    FROM {name}_a WHERE alive AND cum > start_score GROUP BY rid)"""


EXTEND = f"""{SEEDS}, {RUNS}, numbered AS (SELECT *, row_number() OVER (ORDER BY q_id, t_id, q_pos, t_pos) AS rid FROM runs),
  {extension('rgt', 1)}, {extension('lft', -1)}"""
ORACLE["extend_ungapped"] = f"""WITH {EXTEND.replace('q_pos + r.length + o', 'q_pos + r.length + o')}
  SELECT DISTINCT q_id, t_id, q_pos - coalesce(lft.at, 0) AS q_start,
    q_pos + length - 1 + coalesce(rgt.at, 0) AS q_end, t_pos - coalesce(lft.at, 0) AS t_start,
    t_pos + length - 1 + coalesce(rgt.at, 0) AS t_end,
    (coalesce(rgt.best, length) + coalesce(lft.best, length) - length)::BIGINT AS score
  FROM numbered LEFT JOIN rgt USING (rid) LEFT JOIN lft USING (rid)"""


def pair_score(i: int) -> str:
    a, b = f"substring(q.w, {i}, 1)", f"substring(t.w, {i}, 1)"
    group = " ".join(f"WHEN {{0}} IN ({', '.join(repr(s) for s in c)}) THEN {n}" for n, c in enumerate(views.CLASSES))
    return (f"CASE WHEN {a} = {b} THEN {views.SAME} WHEN (CASE {group.format(a)} END) = (CASE {group.format(b)} END) "
            f"THEN {views.SIMILAR} ELSE {views.DIFFERENT} END")


ORACLE["seed_scored"] = f"""WITH {DOCS}, {BENCH}, {PROTEINS}, {BENCH_PROTEINS},
  {windows('qw', 'bprot', 'item_id', 3)}, {windows('tw', 'prot', 'doc_id', 3)},
  near AS (SELECT q.w AS a, t.w AS b, {' + '.join(pair_score(i) for i in (1, 2, 3))} AS score
    FROM (SELECT DISTINCT w FROM qw) q CROSS JOIN (SELECT DISTINCT w FROM tw) t)
  SELECT item_id AS q_id, doc_id AS t_id, qw.start AS q_pos, tw.start AS t_pos, score
  FROM near JOIN qw ON qw.w = a JOIN tw ON tw.w = b WHERE score > 8"""


def letter_score(a: str, b: str) -> str:
    group = " ".join(f"WHEN {{0}} IN ({', '.join(repr(s) for s in c)}) THEN {n}" for n, c in enumerate(views.CLASSES))
    of_a, of_b = f"(CASE {group.format(a)} END)", f"(CASE {group.format(b)} END)"
    return (f"CASE WHEN {of_a} IS NULL OR {of_b} IS NULL THEN 0 WHEN {a} = {b} THEN {views.SAME} "
            f"WHEN {of_a} = {of_b} THEN {views.SIMILAR} ELSE {views.DIFFERENT} END")


def gapped(found: str, queries: str, q_key: str, targets: str, t_key: str, pair: str, start: str, top: int,
           gap_open: int, gap_extend: int) -> str:
    """CTE ``hits``: all cells of both flanks of each seed, row by row, each with the letters of its best way.

    ``k`` tells a pair of letters (0) from a gap in the target (1); a gap in the query is ``g`` letters long. Ways of
    one score: a pair before a gap, a gap in the target before one in the query, the shortest gap.
    """
    def left(cost: str) -> str:
        return f"{cost} - CASE WHEN g = 0 THEN 0 ELSE {gap_open} + (g - 1) * {gap_extend} END"

    def gaps(cost: str) -> str:
        return f"unnest(range(0, greatest(({cost} - {gap_open}) // {gap_extend} + 2, 1))) AS g"

    reach = f"CAST(length(a) + (start + length(a) * {top}) // {gap_extend} + 1 AS BIGINT)"
    return f"""seeded AS (SELECT row_number() OVER () AS rid, f.*, q.seq AS qs, t.seq AS ts, ({start}) AS start
    FROM {found} f JOIN {queries} q ON q.{q_key} = f.q_id JOIN {targets} t ON t.{t_key} = f.t_id),
  sides AS (SELECT 2 * rid AS n, start, reverse(substring(qs, 1, q_pos)) AS a, reverse(substring(ts, 1, t_pos)) AS b FROM seeded
    UNION ALL SELECT 2 * rid + 1, start, substring(qs, q_pos + length + 1), substring(ts, t_pos + length + 1) FROM seeded),
  flanks AS (SELECT n, start, a, substring(b, 1, {reach}) AS b FROM sides),
  cells AS (
    SELECT n, 0 AS i, g AS j, {left("start")} AS total, 0::BIGINT AS down, repeat('-', g) AS q, substring(b, 1, g) AS t,
           '' AS dq, '' AS dt
    FROM (SELECT *, {gaps("start")} FROM flanks) WHERE g <= length(b) AND {left("start")} > 0
    UNION ALL
    SELECT n, i, j, max(v), coalesce(max(CASE WHEN g = 0 THEN down END), 0), max_by(q, v * 1000000 - g),
           max_by(t, v * 1000000 - g), coalesce(max(CASE WHEN g = 0 THEN dq END), ''), coalesce(max(CASE WHEN g = 0 THEN dt END), '')
    FROM (
      SELECT n, i, j + g AS j, g, {left("base")} AS v, down, q || repeat('-', g) AS q, t || substring(b, j + 1, g) AS t, dq, dt
      FROM (
        SELECT *, {gaps("base")} FROM (
          SELECT n, i, j, any_value(b) AS b, max(v) AS base, max_by(q, 2 * v - k) AS q, max_by(t, 2 * v - k) AS t,
                 coalesce(max(CASE WHEN k = 1 THEN v END), 0) AS down, max(CASE WHEN k = 1 THEN q END) AS dq,
                 max(CASE WHEN k = 1 THEN t END) AS dt
          FROM (
            SELECT n, i + 1 AS i, b, j + 1 - k AS j, k,
                   CASE WHEN k = 0 THEN total + {pair} ELSE greatest(total - {gap_open}, down - {gap_extend}) END AS v,
                   CASE WHEN k = 0 OR total - {gap_open} >= down - {gap_extend} THEN q ELSE dq END || x AS q,
                   CASE WHEN k = 0 THEN t || y WHEN total - {gap_open} >= down - {gap_extend} THEN t || '-' ELSE dt || '-' END AS t
            FROM (SELECT c.*, f.b, substring(f.a, i + 1, 1) AS x, substring(f.b, j + 1, 1) AS y, unnest([0, 1]) AS k
                  FROM cells c JOIN flanks f ON f.n = c.n WHERE i < length(f.a))
            WHERE k = 1 OR j < length(b)) WHERE v > 0 GROUP BY n, i, j))
      WHERE j + g <= length(b) AND {left("base")} > 0) GROUP BY n, i, j),
  best AS (SELECT n, max_by({{'q': q, 't': t, 'total': total}}, total * 1000000000000 - i * 1000000 - j) AS p FROM cells GROUP BY n),
  hits AS (SELECT DISTINCT q_id, t_id, q_pos - length(replace(l.p.q, '-', '')) AS q_start,
      t_pos - length(replace(l.p.t, '-', '')) AS t_start,
      reverse(l.p.q) || substring(qs, q_pos + 1, length) || r.p.q AS query_hit,
      reverse(l.p.t) || substring(ts, t_pos + 1, length) || r.p.t AS target_hit, (l.p.total + r.p.total - start)::BIGINT AS score
    FROM seeded JOIN best l ON l.n = 2 * rid JOIN best r ON r.n = 2 * rid + 1)"""


DNA_PAIR = f"CASE WHEN x = y THEN {K.MATCH} ELSE -{K.MISMATCH} END"
ORACLE["align_seeds"] = f"""WITH RECURSIVE {SEEDS}, {RUNS},
  {gapped("runs", "bench", "item_id", "docs", "doc_id", DNA_PAIR, f"length * {K.MATCH}", K.MATCH, K.GAP_OPEN, K.GAP_EXTEND)}
  SELECT * FROM hits"""
TRIPLES = " + ".join(letter_score(f"substring(q.seq, q_pos + {i}, 1)", f"substring(t.seq, t_pos + {i}, 1)") for i in (1, 2, 3))
SCORED = ORACLE["seed_scored"].replace("score > 8", "score > 11")
ORACLE["align_protein_seeds"] = f"""WITH RECURSIVE {SCORED.removeprefix("WITH ").rpartition("SELECT item_id")[0]},
  found AS (SELECT item_id AS q_id, doc_id AS t_id, qw.start AS q_pos, tw.start AS t_pos, 3 AS length
    FROM near JOIN qw ON qw.w = a JOIN tw ON tw.w = b WHERE score > 11),
  {gapped("found", "bprot", "item_id", "prot", "doc_id", letter_score("x", "y"), TRIPLES, views.SAME, K.PROTEIN_GAP_OPEN,
          K.PROTEIN_GAP_EXTEND)}
  SELECT * FROM hits"""

SEARCH = f"""{DOCS}, {BENCH}, strands AS (SELECT 2 * item_id AS q_id, seq FROM bench
    UNION ALL SELECT 2 * item_id + 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM bench),
  {windows('qw', 'strands', 'q_id', WORD)}, {windows('tw', 'docs', 'doc_id', WORD)},
  seeds AS (SELECT q_id, doc_id AS t_id, qw.start AS q_pos, tw.start AS t_pos FROM qw JOIN tw ON qw.w = tw.w), {RUNS},
  {gapped("runs", "strands", "q_id", "docs", "doc_id", DNA_PAIR, f"length * {K.MATCH}", K.MATCH, K.GAP_OPEN, K.GAP_EXTEND)},
  ends AS (SELECT DISTINCT t_id, q_id % 2 = 0 AS forward, t_start + 1 AS low,
      t_start + length(replace(target_hit, '-', '')) AS high FROM hits WHERE score >= 20),
  cut AS (SELECT DISTINCT source AS file, 'D' || doc_id AS id, (high - low + 1)::INTEGER AS length,
      CASE WHEN forward THEN low ELSE high END AS "start", CASE WHEN forward THEN high ELSE low END AS "end",
      CASE WHEN forward AND high > low THEN substring(seq, low, high - low + 1)
        ELSE reverse(substring(seq, low, high - low + 1)) END AS fragment FROM ends JOIN docs ON doc_id = t_id)"""
ORACLE["search_assemblies"] = ORACLE["search_folder"] = f"WITH RECURSIVE {SEARCH} SELECT * FROM cut"

BLOCK = K.ALIGNMENT_BLOCK
ALIGNED = f"""al AS (SELECT doc_id, replace(seq, 'G', '-') AS q, reverse(seq) AS t,
    unnest(range(0, length(seq), {BLOCK})) AS o FROM docs),
  lines AS (SELECT doc_id, (o / {BLOCK})::INTEGER AS block_no, substring(q, o + 1, {BLOCK}) AS qp, substring(t, o + 1, {BLOCK}) AS tp,
    1 + length(replace(substring(q, 1, o), '-', '')) AS q1, 5 + o AS t1 FROM al),
  fmt AS (SELECT doc_id, block_no,
    format('{{:<7s}} {{:7d}} {{}} {{:7d}}', 'Query:', q1, qp, q1 + length(replace(qp, '-', '')) - 1) AS query_line,
    repeat(' ', 16) || list_aggregate(list_transform(range(1, length(qp) + 1), lambda i: CASE
      WHEN substring(qp, i, 1) = substring(tp, i, 1) AND substring(qp, i, 1) <> '-' THEN '|' ELSE ' ' END),
      'string_agg', '') AS bar_line,
    format('{{:<7s}} {{:7d}} {{}} {{:7d}}', 'Target:', t1, tp, t1 + length(tp) - 1) AS target_line FROM lines)"""
ORACLE["format_alignment"] = f"WITH {DOCS}, {ALIGNED} SELECT * FROM fmt"
ORACLE["write_alignment"] = f"""WITH {DOCS}, {ALIGNED}, n AS (SELECT *, 4 * (row_number() OVER (ORDER BY doc_id, block_no) - 1) AS n FROM fmt)
  SELECT n + i AS line, [query_line, bar_line, target_line, ''][i] AS value FROM n, range(1, 5) r(i)"""

# --- similarity -------------------------------------------------------------------------

ORACLE["pairwise_pearson"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  c AS (SELECT vec_id, list_transform(x, lambda e: e - list_avg(x)) AS x FROM v),
  z AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM c),
  p AS (SELECT a.vec_id AS "left", b.vec_id AS "right", list_inner_product(a.x, b.x) AS sim
    FROM z a JOIN z b ON a.vec_id < b.vec_id)
  SELECT "left", "right", round(sim, 6) AS sim FROM p WHERE sim >= {SIMILAR}"""
ORACLE["pairwise_pearson_bounded"] = ORACLE["pairwise_pearson"]
ORACLE["neighbour_pearson"] = """WITH e AS (SELECT a.vec_id, unnest(a.embedding::DOUBLE[]) AS x,
    unnest(b.embedding::DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(corr(x, y), 6) AS r FROM e GROUP BY vec_id"""

EMBEDDED = "v AS (SELECT row_number() OVER (ORDER BY vec_id) AS leaf, embedding::DOUBLE[] AS x FROM embeddings)"
MONTHS = ", ".join(f"sum(CASE WHEN month(l_shipdate) = {m} THEN l_quantity ELSE 0 END)" for m in range(1, 13))
BRANDS = f"""v AS (SELECT row_number() OVER (ORDER BY p_brand) AS leaf, p_brand AS name, [{MONTHS}]::DOUBLE[] AS x
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"""
PAIRS = """c AS (SELECT leaf, list_transform(x, lambda e: e - list_avg(x)) AS x FROM v),
  z AS (SELECT leaf, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM c),
  pairs AS MATERIALIZED (SELECT a.leaf AS l, b.leaf AS r, list_inner_product(a.x, b.x) AS sim FROM z a JOIN z b ON a.leaf < b.leaf)"""
MEMBERS = """SELECT least(x.lab, y.lab) AS a, greatest(x.lab, y.lab) AS b, {}(p.sim) AS sim
      FROM pairs p JOIN st x ON x.leaf = p.l JOIN st y ON y.leaf = p.r WHERE x.lab <> y.lab GROUP BY 1, 2"""
MEANS = """SELECT p.lab AS a, q.lab AS b, corr(p.m, q.m) AS sim
      FROM (SELECT lab, i, avg(e) AS m FROM st JOIN vi ON st.leaf = vi.leaf GROUP BY lab, i) p
      JOIN (SELECT lab, i, avg(e) AS m FROM st JOIN vi ON st.leaf = vi.leaf GROUP BY lab, i) q
      ON p.i = q.i AND p.lab < q.lab GROUP BY 1, 2"""


def merges(vectors: str, best: str) -> str:
    """CTEs of a clustering, one best pair after the other; a cluster is called by its smallest leaf."""
    return f"""{vectors}, vi AS (SELECT leaf, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS e FROM v), {PAIRS},
  st(step, leaf, lab, a, b, sim) AS (
    SELECT 0::BIGINT, leaf, leaf, 0::BIGINT, 0::BIGINT, 0::DOUBLE FROM v
    UNION ALL
    SELECT st.step + 1, st.leaf, CASE WHEN st.lab = o.b THEN o.a ELSE st.lab END, o.a, o.b, o.sim
    FROM st, ({best} ORDER BY sim DESC, a, b LIMIT 1) o),
  done AS (SELECT DISTINCT step, a, b, sim FROM st WHERE step > 0),
  tree AS (SELECT d.step, 'NODE' || d.step AS node,
    coalesce('NODE' || (SELECT max(e.step) FROM done e WHERE e.a = d.a AND e.step < d.step), 'GENE' || d.a) AS "left",
    coalesce('NODE' || (SELECT max(e.step) FROM done e WHERE e.a = d.b AND e.step < d.step), 'GENE' || d.b) AS "right",
    d.sim FROM done d)"""


WALK = """walk(name, path) AS (
    SELECT node, '' FROM tree WHERE step = (SELECT max(step) FROM tree)
    UNION ALL
    SELECT unnest([t."left", t."right"]), unnest([w.path || 'L', w.path || 'R']) FROM walk w JOIN tree t ON t.node = w.name),
  leaf_order AS (SELECT name AS leaf, row_number() OVER (ORDER BY path) AS position FROM walk WHERE name LIKE 'GENE%')"""
TREE = 'SELECT step, node, "left", "right", round(sim, 6) AS sim FROM tree'
SINGLE = merges(EMBEDDED, MEMBERS.format("max"))
ORACLE["linkage_single"] = f"WITH RECURSIVE {SINGLE} {TREE}"
ORACLE["linkage_complete"] = f"WITH RECURSIVE {merges(EMBEDDED, MEMBERS.format('min'))} {TREE}"
ORACLE["linkage_complete_rounds"] = ORACLE["linkage_complete"]
ORACLE["linkage_average"] = f"WITH RECURSIVE {merges(BRANDS, MEANS)} {TREE}"
UNIT = """list_transform(list_transform({0}, lambda e: e - list_avg({0})), lambda e: e / sqrt(list_sum(list_transform(
    {0}, lambda g: (g - list_avg({0})) * (g - list_avg({0}))))))"""
MEAN = "list_transform(list_zip(o.xa, o.xb), lambda p: (p[1] * o.na + p[2] * o.nb) / (o.na + o.nb))"
ORACLE["linkage_average_vectors"] = f"""WITH RECURSIVE {EMBEDDED},
  st(step, lab, n, x, z, a, b, sim) AS (
    SELECT 0::BIGINT, leaf, 1::BIGINT, x, {UNIT.format('x')}, 0::BIGINT, 0::BIGINT, 0::DOUBLE FROM v
    UNION ALL
    SELECT step + 1, lab, n, x, CASE WHEN new THEN {UNIT.format('x')} ELSE z END, a, b, sim FROM (
      SELECT st.step, lab, lab = o.a AS new, CASE WHEN lab = o.a THEN o.na + o.nb ELSE st.n END AS n,
        CASE WHEN lab = o.a THEN {MEAN} ELSE st.x END AS x, st.z, o.a, o.b, o.sim
      FROM st, (SELECT p.lab AS a, q.lab AS b, p.n AS na, q.n AS nb, p.x AS xa, q.x AS xb,
          round(list_inner_product(p.z, q.z), 12) AS sim
        FROM st p JOIN st q ON p.lab < q.lab ORDER BY sim DESC, a, b LIMIT 1) o WHERE lab <> o.b)),
  done AS (SELECT DISTINCT step, a, b, sim FROM st WHERE step > 0),
  tree AS (SELECT d.step, 'NODE' || d.step AS node,
    coalesce('NODE' || (SELECT max(e.step) FROM done e WHERE e.a = d.a AND e.step < d.step), 'GENE' || d.a) AS "left",
    coalesce('NODE' || (SELECT max(e.step) FROM done e WHERE e.a = d.b AND e.step < d.step), 'GENE' || d.b) AS "right",
    d.sim FROM done d) {TREE}"""
ORACLE["leaf_order"] = f"WITH RECURSIVE {SINGLE}, {WALK} SELECT leaf, position FROM leaf_order"
ORACLE["write_gtr"] = f"""WITH RECURSIVE {merges(BRANDS, MEMBERS.format('max'))}
  SELECT step AS line, concat_ws(chr(9), node || 'X', "left" || 'X', "right" || 'X', round(sim, 4)) AS value FROM tree"""
ORACLE["write_cdt"] = f"""WITH RECURSIVE {merges(BRANDS, MEMBERS.format('min'))}, {WALK}
  SELECT position + 2 AS line, concat_ws(chr(9), 'GENE' || v.leaf || 'X', name, name, 1, array_to_string(x::VARCHAR[], chr(9))) AS value
  FROM v JOIN leaf_order o ON o.leaf = 'GENE' || v.leaf
  UNION ALL SELECT 1, concat_ws(chr(9), 'GID', 'CLID', 'NAME', 'GWEIGHT', {", ".join(f"'m{m}'" for m in range(1, 13))})
  UNION ALL SELECT 2, concat_ws(chr(9), 'EWEIGHT', '', '', '', {", ".join("1" for _ in range(12))})"""
ORACLE["write_gtr_vectors"] = f"""WITH RECURSIVE {SINGLE}
  SELECT step AS line, concat_ws(chr(9), node || 'X', "left" || 'X', "right" || 'X', format('{{:.4f}}', sim)) AS value FROM tree"""
ORACLE["write_cdt_vectors"] = f"""WITH RECURSIVE {merges(EMBEDDED, MEMBERS.format('min'))}, {WALK},
  named AS (SELECT row_number() OVER (ORDER BY vec_id) AS leaf, vec_id AS name FROM embeddings)
  SELECT position + 2 AS line, concat_ws(chr(9), 'GENE' || v.leaf || 'X', name, name, 1,
    array_to_string(list_transform(x, lambda e: format('{{:.6f}}', e)), chr(9))) AS value
  FROM v JOIN named ON named.leaf = v.leaf JOIN leaf_order o ON o.leaf = 'GENE' || v.leaf
  UNION ALL SELECT 1, concat_ws(chr(9), 'GID', 'CLID', 'NAME', 'GWEIGHT',
    array_to_string(list_transform(range(1, max(len(x)) + 1), lambda i: 'e' || i), chr(9))) FROM v
  UNION ALL SELECT 2, concat_ws(chr(9), 'EWEIGHT', '', '', '',
    array_to_string(list_transform(range(1, max(len(x)) + 1), lambda i: '1'), chr(9))) FROM v"""

# --- readers and writers ----------------------------------------------------------------

ORACLE["read_fasta"] = f"WITH {DOCS} SELECT header, seq FROM docs"
ORACLE["read_fasta_pieces"] = f"""WITH {DOCS} SELECT header, length(seq) AS n, CEIL(length(seq) / 60)::BIGINT AS n_pieces,
  CASE WHEN length(seq) % 60 IN (1, 2) THEN right(seq, length(seq) % 60) ELSE right(seq, 3) END AS last FROM docs"""
ORACLE["read_fasta_first"] = f"""WITH {DOCS} SELECT first(header ORDER BY doc_id) AS header,
  first(seq ORDER BY doc_id) AS seq FROM docs GROUP BY source"""
ORACLE["read_matrix"] = """SELECT vec_id, (i - 1)::INTEGER AS sample, round(embedding[i]::DOUBLE, 6) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""
TRACKED = """tr AS (SELECT event_id AS gene, (user_id % 7)::INTEGER AS chr,
    CASE WHEN event_id % 10 NOT IN (3, 4, 5) THEN value END AS value FROM events)"""
ORACLE["read_tracking"] = f"WITH {TRACKED} SELECT * FROM tr"
ORACLE["tracking_profile"] = f"WITH {TRACKED} {profile('chr', 'gene', 'gene', 'tr')}"
ORACLE["read_blastn_report"] = """SELECT DISTINCT 'q' || c_custkey AS query_name,
  replace(c_name, '#', ' ') || ' second line' AS query_description, c_custkey * 3 AS query_length,
  o_orderkey IS NULL AS no_hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey"""
ORACLE["read_blastn_subjects"] = """SELECT 'q' || o_custkey AS query_name,
  format('{:03d}.{:03d}', o_orderkey % 200, o_orderkey) AS name, 'part of ' || o_orderkey AS description,
  o_custkey + 100 AS length, '2e-' || lpad((o_orderkey % 90 + 10)::VARCHAR, 3, '0') AS expect
  FROM orders JOIN customer ON o_custkey = c_custkey"""
SUBJECT_FIELDS = """format('{:03d}.{:03d}', o_orderkey % 200, o_orderkey) AS name, 'part of ' || o_orderkey AS description,
  o_custkey + 100 AS length, '2e-' || lpad((o_orderkey % 90 + 10)::VARCHAR, 3, '0') AS expect"""
OPENING = "'q' || c_custkey || ',' || replace(c_name, '#', ' ') || ' second line,' || c_custkey * 3"
ORACLE["write_query_hits"] = f"""WITH s AS (SELECT o_custkey, o_orderkey, {SUBJECT_FIELDS}
    FROM orders JOIN customer ON o_custkey = c_custkey),
  l AS (SELECT o_custkey, o_orderkey // 20000 AS run,
    string_agg(concat_ws(',', name, description, length, expect), ',' ORDER BY o_orderkey) AS hits FROM s GROUP BY 1, 2)
  SELECT concat_ws(',', {OPENING}, hits) AS value FROM customer LEFT JOIN l ON o_custkey = c_custkey"""
ORACLE["write_nohits"] = f"""SELECT {OPENING} AS value FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
ORACLE["read_damaged_subjects"] = f"""SELECT {SUBJECT_FIELDS} FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 10 > 1"""
ORACLE["report_skipped"] = """WITH b AS (SELECT DISTINCT c_custkey, o_orderkey // 20000 AS run
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
  r AS (SELECT 'query' AS kind, CASE c_custkey % 10 WHEN 0 THEN 'no name' WHEN 1 THEN 'no length' END AS reason FROM b
    UNION ALL SELECT 'subject', CASE WHEN o_orderkey % 11 = 0 THEN 'no name' WHEN o_orderkey % 7 = 0 THEN 'no e-value'
      WHEN o_custkey % 10 < 2 THEN 'query skipped' END FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT kind, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2"""
EVENT_HITS = """eh AS (SELECT 'VCU' || user_id || 'contig' || user_id AS contig, event_type AS gene, event_id,
    (event_id % 900 + 50 + CASE WHEN event_id % 2 = 1 THEN 0.5 ELSE 0 END)::DOUBLE AS bits,
    (event_id % 9 + 1) || 'e-' || lpad((event_id % 190)::VARCHAR, 3, '0') AS evalue FROM events),
  big AS (SELECT * FROM eh WHERE bits >= 100)"""
ORACLE["read_blastp_report"] = f"WITH {EVENT_HITS} SELECT contig, gene, bits, evalue FROM big"
ORACLE["read_blastp_descriptions"] = """SELECT event_type AS gene,
  event_type || ' kind ofprotein ' || event_id % 10 AS description, count(*) AS n FROM events GROUP BY 1, 2"""
ORACLE["report_best_hits"] = f"""WITH {EVENT_HITS},
  l AS (SELECT contig, gene, arg_max(evalue, event_id) AS evalue FROM big GROUP BY 1, 2),
  ord AS (SELECT event_type AS gene, event_type || ' kind ofprotein ' || event_id % 10 AS description,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id // 1000 DESC, user_id DESC, event_id DESC) AS r FROM events)
  SELECT contig, l.gene, description, evalue FROM l JOIN ord ON l.gene = ord.gene AND r = 1
  WHERE evalue::DOUBLE < 1e-50"""
ORACLE["read_tables"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))
ORACLE["write_scores"] = f"""WITH sc AS ({ORACLE['markov_score']})
  SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS line, format('{{:6.1f}}', score) || chr(9) || doc_id || chr(9)
    || 'D' || doc_id || chr(9) || 'text ' || lang || chr(9) || 'g' || n_chars AS value FROM sc JOIN documents USING (doc_id)"""
