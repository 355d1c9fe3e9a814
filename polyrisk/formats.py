"""Fixed values of the reference's file formats, stated once.

These must equal the reference's for its files to be read and written
interchangeably.
"""

# The reference's column names for the canonical columns.
REFERENCE_NAMES = {
    "subject_id": "ID",
    "episode_id": "fin_grossesse",
    "code": "medicament",
    "outcome": "diagnosis",
    "count_outcome_0": "count_diagnosis_0",
    "count_outcome_1": "count_diagnosis_1",
    "p_neg_nodrug": "proba_healthy_nodrug",
    "p_neg_drug": "proba_healthy_drug",
    "p_pos_nodrug": "proba_nothealthy_nodrug",
    "p_pos_drug": "proba_nothealthy_drug",
}

# Vocabulary-file entries that are not codes, and the prefix
# that code columns carry in the wide file.
NON_CODE_ENTRIES = ("risk", "diagnosis")
CODE_PREFIX = "_"

#: Options under which texts with quotes, marks and blanks at their ends keep them.
CSV_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
