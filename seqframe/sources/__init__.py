from .fasta import first_record, read_fasta, read_fasta_pieces  # noqa: F401
from .reports import (  # noqa: F401
    blastn_skipped, blastp_descriptions, blastp_summary, read_blastn_report, read_bp_hits,
)
from .tables import (  # noqa: F401
    load_model, read_intervals, read_matrix, read_motifs, read_substitutions, read_tables,
    read_tracking, wide_to_vectors,
)
