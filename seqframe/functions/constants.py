"""Fixed values of the analyses. Results depend on them, so they are plain text here."""

# Standard genetic code, bases in T, C, A, G order, '_' for a stop.
CODON_BASES = "TCAG"
CODON_RESIDUES = (
    "FFLLSSSSYY__CC_W"
    "LLLLPPPPHHQQRRRR"
    "IIIMTTTTNNKKSSRR"
    "VVVVAAAADDEEGGGG"
)
STOP = "_"

# Alphabets.
NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Background frequencies of the four bases for position weights.
BASE_BACKGROUND = {"A": 0.33264, "C": 0.16736, "G": 0.16736, "T": 0.33264}

# Residue frequencies for substitution scores.
RESIDUE_FREQUENCY = {
    "A": 0.087, "C": 0.033, "D": 0.047, "E": 0.050, "F": 0.040,
    "G": 0.089, "H": 0.034, "I": 0.037, "K": 0.081, "L": 0.085,
    "M": 0.015, "N": 0.040, "P": 0.051, "Q": 0.038, "R": 0.041,
    "S": 0.070, "T": 0.058, "V": 0.065, "W": 0.010, "Y": 0.030,
}

# Scoring defaults.
PSEUDOCOUNT = 0.1
INFORMATION_THRESHOLD = 1.2
UNSEEN_LOG_Q = -8.0
MATCH, MISMATCH = 1, 2
GAP_OPEN, GAP_EXTEND = 5, 2
WORD_LENGTH = 5
PROTEIN_GAP_OPEN, PROTEIN_GAP_EXTEND = 11, 1
PROTEIN_WORD_LENGTH = 3
PROTEIN_WORD_THRESHOLD = 15
ALIGNMENT_BLOCK = 50

# Header formats.
# "name (length nt) <-start ORTH:e-value description", or start-> on the other strand
ORF_HEADER = r"(\w+)\s+\((\d+).*\)\s+(?:(<-)(\d+)|(\d+)(->))\s+(?:ORTH:(\S+))?\s*(.*)$"
# "tr|accession|name description OS=organism GN=gene PE=..."
PROTEIN_HEADER = r"\w{2}\|(.*?)\|.*?\s(.*?)\sOS=.*?GN=(.*?)\s"
# "id [attribute] [attribute]"
CONTIG_HEADER = r"^(.*?)\s\["
