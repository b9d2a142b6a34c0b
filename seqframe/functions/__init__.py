from .scalars import (  # noqa: F401
    complement, contig_id, count_chars, cut, dna_view, evalue_number, first_token, gc_count,
    orf_header, pearson, protein_header, strand_cut, translate_codons,
)
