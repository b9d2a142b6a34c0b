import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from seqframe.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, `index` int, digest string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(nodes):
    return [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]


def climb(nodes, i, digest):
    """Root of the nodes, root with another digest in place i, and siblings on the way."""
    others = []
    while len(nodes) > 1:
        a = i // 8 * 8
        run = nodes[a:a + 8]
        others += run[:i - a] + run[i - a + 1:]
        digest = h(*run[:i - a], digest, *run[i - a + 1:])
        nodes, i = up(nodes), i // 8
    return nodes[0], digest, others


def lowered(t):
    return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows):
    """(doc_id, leaf, subroot, root, folded, proof) of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, t, lang, source, n in rows:
        head = [field(x) for x in (i, source, lang, n)]
        other = lowered(t) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        groups.setdefault(lang, []).append((i, h(*head, field(t)), h(*head, field(other))))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots = [climb([r[1] for r in groups[n]], 0, "")[0] for n in names]
    out = []
    for k, n in enumerate(names):
        leaves = [r[1] for r in groups[n]]
        for at, (i, leaf, found) in enumerate(groups[n]):
            subroot, folded, others = climb(leaves, at, found)
            root, folded, more = climb(subroots, k, folded)
            out.append((i, leaf, subroot, root, folded, h(*others, *more)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.folded_root.hex(), h(bytes(r.proof).hex()))
                   for r in df.collect()), key=repr)


def some_rows(n, langs):
    return [(i * 7 % 1009, f"Text {i} É" * (i % 4), langs[i * i % len(langs)], None if i % 5 == 0 else f"s{i % 3}", i)
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def tree_of(df, levels=1):
    # T is the only letter of these texts that an English lower case changes
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "T", "t")).otherwise(F.col("text"))
    return merkle.manifest(df, FIELDS, changed={"text": text}, levels=levels)


@pytest.mark.parametrize("levels", [1, 2])
def test_equal_to_the_plain_version(spark, levels):
    rows = some_rows(150, ["en", "fr", None, "en"]) + [(2000, None, "one", None, None), (None, "T", "fr", "s", 1),
                                                      (2001, "T" * 5000, "", "", 0), (None, "T", "fr", "s", 1)]
    rows += [(3000 + i, "T", f"l{i}", "s", i) for i in range(20)]
    assert found(tree_of(frame(spark, rows), levels)) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_sizes_of_one_group(spark, n):
    rows = some_rows(n, ["en"])
    assert found(tree_of(frame(spark, rows))) == plain(rows)


def test_repeated_rows_are_leaves_side_by_side(spark):
    rows = [(5, "Text", "en", "s", 1)] * 30 + [(5, "Other", "en", "s", 1), (6, "T", "en", "s", 1)]
    assert found(tree_of(frame(spark, rows))) == plain(rows)


def test_a_version_owns_only_the_nodes_above_its_leaf(spark):
    """The root of a version, read from its own nodes and, for all others, the first tree."""
    rows = some_rows(100, ["en"])
    out = tree_of(frame(spark, rows)).collect()
    base = {}
    level, nodes = 0, [r.leaf.hex() for r in sorted(out, key=lambda r: r["index"])]
    while True:
        base.update({(level, i): d for i, d in enumerate(nodes)})
        if len(nodes) == 1:
            break
        level, nodes = level + 1, up(nodes)
    assert {bytes(r.root).hex() for r in out} == {nodes[0]}
    changed = [r for r in out if r.copied]
    assert 0 < len(changed) < len(out)
    assert all(bytes(r.folded_root) == bytes(r.root) for r in out if not r.copied)
    for r in changed:
        own = {(k + 1, r["index"] // 8 ** (k + 1)): bytes(d).hex() for k, d in enumerate(r.copied)}
        assert len(own) == level
        for (k, i) in own:
            below = [own.get((k - 1, j), base.get((k - 1, j))) for j in range(8 * i, 8 * i + 8) if (k - 1, j) in base]
            if k > 1:
                assert own[k, i] == h(*below)
    nodes_of = merkle.version_nodes(tree_of(frame(spark, rows))).collect()
    assert len(nodes_of) == level * len(changed)


def test_all_nodes_of_the_first_version(spark):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(70)]
    rows = [("a", i, 70, d) for i, d in enumerate(leaves)] + [("b", 0, 1, leaves[3])]
    tree = merkle.build(spark.createDataFrame(rows, "tree string, `index` long, total long, digest binary"), 1)
    got = {(r.tree, r.level, r["index"]): bytes(r.digest).hex() for r in tree.nodes().collect()}
    want, level, nodes = {("b", 0, 0): leaves[3].hex()}, 0, [d.hex() for d in leaves]
    while True:
        want |= {("a", level, i): d for i, d in enumerate(nodes)}
        if len(nodes) == 1:
            break
        level, nodes = level + 1, up(nodes)
    assert got == want


def test_query_is_the_operator_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in queries.table(spark, d, "documents").collect()]
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.folded_root, r.proof_sha256, r.verified) for r in
                  queries.QUERIES["op11_merkle_manifest"](spark, d).collect()), key=repr)
    assert got == [(*w, w[3] == w[4]) for w in plain(rows)]
