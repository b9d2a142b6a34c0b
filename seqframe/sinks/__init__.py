from .text import (  # noqa: F401
    save_model, write_alignment, write_cdt, write_dump, write_fasta, write_gtr, write_hits,
    write_lines, write_multi_contig, write_nohits, write_query_hits, write_scores, write_statistics,
    write_support, write_table,
)
