"""Words, texts and limits that results must carry as they are."""

# Phase kinds, in report order.
PHASE_KINDS = ["scan", "geiger", "miri", "fuzz"]

# Statuses from least to most severe; the position is the severity (1-based).
STATUS_BY_SEVERITY = ["skipped", "clean", "pass", "error", "finding"]

# Text that marks undefined behaviour in an interpreter log (ASCII case ignored).
UB_MARKERS = ["undefined behavior", "ub:", "stacked borrow", "out-of-bounds", "uninitialized"]

# Categories of undefined behaviour, first match wins (ASCII case ignored).
UB_CATEGORIES = [
    ("provenance", ["provenance", "stacked borrow"]),
    ("alignment", ["alignment", "unaligned"]),
    ("out_of_bounds", ["out-of-bounds", "bounds"]),
    ("uninitialized", ["uninitialized"]),
]
UB_OTHER = "other_ub"

# Text that marks a failed fuzz run as a finding (ASCII case ignored).
FUZZ_FINDING_MARKERS = ["panic", "crash", "artifact_prefix", "timeout", "out-of-memory", "oom"]

# Both must occur for a leak-checker failure caused by the environment (ASCII case ignored).
LSAN_PTRACE_MARKERS = ["leaksanitizer has encountered a fatal error", "does not work under ptrace"]

# Both must occur for a known failure of the package counter (case matters).
COUNTER_PANIC_MARKERS = ["thread 'main'", "assertion failed: self.pending_ids.insert(id)"]

# Separator between the strict and the baseline part of an interpreter log.
BASELINE_SEPARATOR = "\n\n--- baseline ---\n"

# Seconds a profile allows per fuzz target; no entry: no cap.
PROFILE_CAPS = {"smoke": 30, "baseline": 300}
DEFAULT_BUDGET_SECONDS = 60

# An excerpt up to this many bytes is kept whole, else this many last characters remain.
EXCERPT_LIMIT = 700

# Review rows per crate.
REVIEW_ROWS = 10

# Directory names a corpus walk does not enter.
PRUNED_DIRECTORIES = ["target", ".git", "fuzz", "vendor", ".cargo"]

# Words in a review reason, most urgent first; any other reason comes last.
REVIEW_WORDS = ["transmute", "ptr", "unchecked"]
REVIEW_SUFFIX = " with dynamic finding in crate scope"

# Characters with the Unicode property White_Space.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
