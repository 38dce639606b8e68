"""Fixed values of the data model: code lists, calendars, names and thresholds."""

MIN_PASSING_GRADE = 1.0
FULL_TIME_CREDITS = 12.0
CREDIT_CHECK = 12
FIRST_TERM = "FALL"
CORE_TERMS = ("FALL", "SPRING")
#: Order of the terms of an academic year.
TERMS = ("FALL", "WINTER", "SPRING", "SUMMER")
#: (month, day) of each term's first and last day.
TERM_BOUNDS = {"FALL": ((9, 1), (12, 31)), "WINTER": ((1, 1), (1, 31)), "SPRING": ((2, 1), (5, 31)), "SUMMER": ((6, 1), (8, 31))}
#: Rank of seasons in free-form term labels; it differs from the order of TERMS.
SEASON_RANK = {"spring": 1, "summer": 2, "fall": 3, "winter": 4}
PEAK_COVID_TERMS = (("2019-20", "SPRING"), ("2019-20", "SUMMER"), ("2020-21", "FALL"), ("2020-21", "WINTER"), ("2020-21", "SPRING"), ("2020-21", "SUMMER"))
COURSE_LEVEL_PATTERN = r"^(?P<course_level>\d)\d{2}(?:[A-Z]{,2})?$"

LETTER_GPA = {"A+": "4", "A": "4", "A-": "3.7", "B+": "3.3", "B": "3", "B-": "2.7", "C+": "2.3", "C": "2", "C-": "1.7", "D+": "1.3", "D": "1", "D-": "0.7", "F": "0"}
STATUS_GRADES = ("P", "PASS", "S", "SAT", "U", "UNSAT", "W", "WD", "I", "IP", "AU", "NG", "NR", "M", "O")
STATUS_GRADE_MAP = {"W1": "W", "W2": "W", "NSW": "W", "OTHER": "O", "OTH": "O", "NC": "NR", "NCR": "NR", "AUD": "AU", "COVID_I": "I", "IP": "I", "ADW": "WD", "MP": "M"}
#: Fixed values, made of the lists above.
NON_NUMERIC_GRADES = tuple(sorted({*LETTER_GPA, *STATUS_GRADES}))
NON_PASS_FAIL_GRADES = tuple(sorted(({*STATUS_GRADES, "A"}) - {"F", "P", "PASS"}))
INCOMPLETE_GRADES = ("I", "W", "WD", "IP")
#: Upper edges of letter grades on the four-point scale, lowest first.
GRADE_BINS = ((0.69, "F"), (1.69, "D"), (2.69, "C"), (3.69, "B"), (4.01, "A"))
#: Grades of each kind in the ranking of courses by failures, and those that count as completed.
DFWI_GRADES = {"D": ("D", "DD"), "F": ("F", "NP", "WF"), "W": ("W", "WD"), "I": ("I", "IP")}
COMPLETED_GRADES = ("A", "B", "C", "P")
#: Grades and flags that say that a course was passed or failed.
PASSING_GRADES = ("P", "P*", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-")
FAILING_GRADES = ("F", "E", "^E", "F*", "REF", "NR", "W", "W*", "I")
PASS_FLAGS, FAIL_FLAGS = ("P",), ("F",)
#: Labels in raw files: canonical value, parts that mean it anywhere, whole labels that mean it; the first that fits wins.
TERM_LABELS = (("FALL", ("FALL",), ("FA",)), ("WINTER", ("WINTER",), ("WI",)), ("SPRING", ("SPRING",), ("SP",)), ("SUMMER", ("SUMMER",), ("SU", "SM")))
ENROLLMENT_LABELS = (("FIRST-TIME", ("FIRST", "FRESHMAN", "TIME"), ()), ("TRANSFER-IN", ("TRANSFER",), ()), ("RE-ADMIT", ("RE-ADMIT", "READMIT"), ()))
PELL_LABELS = (("Y", (), ("Y", "YES")), ("N", (), ("N", "NO")))
CREDENTIAL_LABELS = (("Bachelor's", ("BACHELOR", "BA ", "BS "), ("BA", "BS")), ("Associate's", ("ASSOCIATE", "AA ", "AS ", "AAS"), ("AA", "AS", "AAS")), ("Certificate", ("CERTIFICATE", "CERTIFICATION"), ()))
AGE_BUCKETS = (("20 AND YOUNGER", 13, 20), (">20 - 24", 21, 24), ("OLDER THAN 24", 25, 100))
YOUNGER_LABELS = (("YOUNGER", "20 AND"), ("<=20", "UNDER 21", "UNDER21"))
MIDDLE_PARTS = (">20", "20 - 24", "20-24", "21-24")
DUAL_ENROLLMENT = ("DE", "DS", "SE")

SPLIT = {"train": 0.6, "test": 0.2, "validate": 0.2}
#: Bias flags: least difference of rates, largest p-value, weight in scores.
BIAS_LEVELS = (("🔴 HIGH BIAS", 0.15, 0.01, 1.0), ("🟠 MODERATE BIAS", 0.10, 0.01, 0.75), ("🟡 LOW BIAS", 0.05, 0.1, 0.25))
NO_BIAS, FEW_DATA = "🟢 NO BIAS", "⚪ INSUFFICIENT DATA"
#: Rows that a test of two rates needs on each side; share of all positives, and number, that make a subgroup comparable.
Z_TEST_ROWS, POSITIVE_SHARE, POSITIVE_ROWS = 30, 0.15, 50
NULL_SHARE, VARIANCE, VIF = 0.2, 0.0, 10.0
DTYPE_SHARE, DTYPE_ROWS = 0.75, 10
PROFILE_VALUES, PROFILE_TOP = 50, 5
TERM_DIFF_COLUMNS = ("num_courses", "num_credits_earned", "course_grade_numeric_mean", "course_level_mean")
NULL_TOKENS = ("", "NA", "N/A", "NULL", "NONE", "NAN", "UNKNOWN")
