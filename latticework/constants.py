"""Fixed values that define the descriptors; results depend on every one of them."""

R_MAX = 8.0
N_BINS = 64
BIN_WIDTH = R_MAX / N_BINS
CN_RADII = (2.0, 3.0, 4.0, 6.0)
SMEAR_SIGMA_BINS = 1.0
SMEAR_REACH = 4
RDF_CLIP = 1e4
M_ENV = 16
K_ENV = 16
R_ENV = 6.0
N_RBF = 16
MAX_TYPES = 8
N_CLASSES = 94
VAL_MODULUS = 10
N_PAIR_EXTRA = 8
N_GLOB = 3

# Distances and bin positions closer than this to an edge count as lying on the edge.
EDGE_EPS = 1e-9

# Length units: name, order of preference, factor to Angstrom.
UNITS = (
    ("angstrom", 0, 1.0),
    ("bohr", 1, 0.529177),
    ("nm", 2, 10.0),
    ("um", 3, 1.0e4),
    ("cm", 4, 1.0e8),
    ("m", 5, 1.0e10),
)
NN_WINDOW = (0.6, 3.6)
UNIT_SCORE_ACCEPT = 0.60
UNIT_TIE_MARGIN = 0.15
ANGSTROM_PRIOR_MARGIN = 0.30

# Joint decoding weights.
W_PMI = 0.5
W_NEUTRALITY = 1.5
PMI_ALPHA = 2.0
TOP_K = 10
BEAM = 300
