"""Controlled vocabularies of checks."""

# The order of each list is its rank.
STATUS_DEDUPE = ["pass", "info", "bonus", "warning", "skipped", "fail"]  # later is worse
STATUS_REPORT = ["fail", "skipped", "warning", "bonus", "info", "pass"]  # earlier is worse
SEVERITY = ["critical", "major", "minor", "style"]
SEVERITY_DEFAULT = 9
SCORED_CATEGORIES = ["structure", "syntax", "functions", "explicit_tests", "derived_tests", "output", "constraints", "runtime", "git"]

# Sets of statuses.
MANDATORY = ["pass", "warning", "fail", "skipped"]
PASSED = ["pass", "warning"]
FAILING = ["fail", "skipped"]
PROGRESS = [*MANDATORY, "bonus"]
PROGRESS_FAILING = [*FAILING, "bonus"]
ISSUE = ["fail", "skipped", "bonus", "warning"]
BEHAVIOUR_CATEGORIES = ["explicit_tests", "derived_tests", "output"]
HEURISTIC_CATEGORY = "heuristic_tests"
FIXABLE = ["fail", "skipped", "warning"]

# Diagnoses, prefixes of check ids that end in a path, limits.
MISSING_FILE = ["missing_file", "missing_bonus_file"]
MISSING_FUNCTION = ["missing_function", "bonus_not_implemented"]
PATH_PREFIXES = ["structure:file:", "syntax:", "git:untracked:", "git:ignored:"]
MIN_TESTS_PER_FUNCTION = 2

# Why confidence is lowered, in order; the count or list is put in place of {}.
NOTHING_VERIFIED = "No mandatory requirement could be verified."
NO_EXPLICIT_TEST = "No explicit test was found in the subject: behaviour was not checked against official examples."
AI_NOT_REVIEWED = "{} requirement(s) were extracted by AI and have not been reviewed."
UNDER_TESTED = "{} mandatory function(s) have fewer than 2 explicit or derived tests: {}."
HEURISTIC_WARNINGS = "{} heuristic test warning(s): extra cases that are not official requirements failed."
PARSER_NOTES = "The subject parser left {} note(s) about ambiguous or unformalized parts of the subject."
LOCAL_SANDBOX = "Developer mode sandbox: student code ran locally with weaker isolation than Docker."
NO_REQUIREMENT = "No mandatory requirement could be verified from the subject."
READY = "All requirements that could be verified from the subject passed. Hidden grader tests may still exist."
REMAINING, CRITICAL_FIRST = "{} mandatory failure(s) remain.", " Fix critical issues first."
