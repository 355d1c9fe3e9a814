"""Parameters of the registered queries (shared by Spark and oracle twins)."""

from polyrisk.sources.tables import CODE_COLUMNS  # noqa: F401  (re-export)

CODE = "brand"
# Driver data: p_brand takes the values Brand#1 .. Brand#25 (a rule, not a list).
BRAND_CODES = [f"Brand#{i}" for i in range(1, 26)]

THRES = 2000              # support threshold of the screen (reference CLI --thres)
MIN_COMBO_COUNT = 2       # frequency filter: combinations seen more than twice
SAMPLE_FRACTION = 0.4     # reference config sample_fraction
SAMPLE_SEED = 40          # reference config sample_random_state
N_SPLITS = 3              # reference config n_splits
ERROR_SEED = 42           # sampling-error study random_state
ERROR_FRACTIONS = (0.25, 0.5, 0.75, 1.0)
QUANTILE_DECIMALS = 12
DENSITY_DECIMALS = 9
GRADIENT_DECIMALS = 6
LOSS_DECIMALS = 10      # sums of ~1e4 logs: keep far above summation-order noise

# Registered queries read episodes materialised once per session (the
# reference's build-once, read-many multi-hot file); False rebuilds them in
# every query plan.
MATERIALISE_EPISODES = True
