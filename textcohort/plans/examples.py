"""The example table of the workflow: which ranked texts are shown and how they are cleaned."""

from __future__ import annotations

from textcohort.functions.text import CLEAN_RULES_BASE, CLEAN_RULES_MIN, CLEAN_RULES_SHORT, CLEAN_RULES_SLASH
from textcohort.operators.report import STOP_BASE, Pick

# Picks of the no-symptom cohort's example table (fold 0).  Positives are counted
# from the highest rank down, negatives from the lowest up; each pick has its own replacement
# rules, extra stop tokens and tail trims.
EXAMPLE_FOLD = 0
EXAMPLE_PICKS = [
    Pick(label=1, k=6, rules=CLEAN_RULES_MIN, strip="right",
         stop=STOP_BASE + ["s ", "d ", "ed"]),
    Pick(label=1, k=24, rules=CLEAN_RULES_SHORT, strip="right",
         stop=STOP_BASE + ["ers"]),
    Pick(label=0, k=0, rules=CLEAN_RULES_SHORT,
         stop=STOP_BASE + ["ers", "ve ", "gging "]),
    Pick(label=0, k=2, rules=CLEAN_RULES_SHORT + [("none ", "")],
         stop=STOP_BASE + ["ers", "ve ", "gging ", "none"], trim_chars=3, trim_items=1),
    Pick(label=0, k=9, rules=CLEAN_RULES_SHORT,
         stop=STOP_BASE + ["ers", "ve ", "gging ", "none", "1", "/"]),
    Pick(label=0, k=10, rules=CLEAN_RULES_SHORT + [("  ", " "), ("a n", "an")],
         stop=STOP_BASE + ["ers", "ve ", "gging ", "n ", "chy ", "cus ", ".  "]),
]

# Picks of the example table of the cohort whose negatives have code 5 (fold 6).
EXAMPLE_FOLD_5 = 6
EXAMPLE_PICKS_5 = [
    Pick(label=1, k=4, rules=CLEAN_RULES_BASE, stop=STOP_BASE + ["ers", "ve ", "s "]),
    Pick(label=1, k=14, rules=CLEAN_RULES_BASE, stop=STOP_BASE + ["ers", "ve ", "s "]),
    Pick(label=0, k=5, rules=CLEAN_RULES_SHORT, stop=STOP_BASE + ["ers", "ve ", "gging ", ") "]),
    Pick(label=0, k=7, rules=CLEAN_RULES_SHORT, stop=STOP_BASE + ["ers", "ve ", "gging ", "s ", "cer"], trim_chars=3, trim_items=1),
    Pick(label=0, k=17, rules=CLEAN_RULES_SHORT, stop=STOP_BASE + ["ers", "ve ", "gging ", "s ", "cer"]),
    Pick(label=0, k=19, rules=CLEAN_RULES_SLASH, stop=STOP_BASE + ["ers", "ve ", "gging ", "n ", "chy ", "cus ", ".  "]),
]

#: The fold and picks of each study, by the code of its negative class.
EXAMPLES = {6: (EXAMPLE_FOLD, EXAMPLE_PICKS), 5: (EXAMPLE_FOLD_5, EXAMPLE_PICKS_5)}
