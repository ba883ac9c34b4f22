"""The three document domains: fields, kinds, labels, and the settings of generation and scoring, with their checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields as fields_of

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field paths, kinds and label variants by domain.
DOMAINS: dict[str, dict[str, tuple[str, list[str]]]] = {
    "receipts": {
        "vendor_name": ("string", ["Vendor", "Vnd", "Store", "Merchant", "Shop"]),
        "date": ("date", ["Date", "Dt", "Invoice Date", "Bill Date"]),
        "time": ("time", ["Time", "Tm"]),
        "receipt_number": ("string", ["Receipt No", "Rcpt No", "Bill No", "Invoice No", "Ref No"]),
        "subtotal": ("number", ["Subtotal", "Sub Total", "Sub-Total"]),
        "tax_amount": ("number", ["Tax", "GST", "VAT", "Tax Amount"]),
        "total_amount": ("number", ["Total", "Grand Total", "Amount Due", "Net Amount"]),
        "currency": ("currency", ["Currency", "Curr"]),
        "payment_method": ("string", ["Payment", "Pymnt", "Paid By", "Mode"]),
        "line_items": ("string", ["Items", "Line Items", "Details", "Description"]),
    },
    "insurance": {
        "policyholder.name": ("string", ["Name", "Namc", "Policy Holder", "Insured"]),
        "policyholder.dob": ("date", ["DOB", "D.O.B", "Date of Birth", "Birth Date", "D08"]),
        "policyholder.gender": ("string", ["Gender", "Sex"]),
        "policyholder.contact_number": ("phone", ["Contact", "Phone", "Mobile", "Ph No"]),
        "policyholder.address": ("string", ["Address", "Addr", "Residence"]),
        "policy.policy_number": ("string", ["Policy No", "Polcy No", "Pol No", "Policy Number"]),
        "policy.policy_type": ("string", ["Type", "Policy Type", "Typc", "Plan"]),
        "policy.start_date": ("date", ["Start Date", "From", "Effective Date"]),
        "policy.end_date": ("date", ["End Date", "To", "Expiry", "Maturity Date"]),
        "premium.amount": ("number", ["Premium", "Premum", "Amount"]),
        "premium.currency": ("currency", ["Currency", "Curr"]),
        "premium.payment_frequency": ("frequency", ["Frequency", "Payment Mode", "Pay Freq"]),
        "agent.name": ("string", ["Agent", "Agent Name", "Advisor"]),
        "agent.agent_id": ("string", ["Agent ID", "Advisor ID", "ID"]),
    },
    "hospital": {
        "patient.name": ("string", ["Patient", "Patcnt", "Name", "Patient Name"]),
        "patient.dob": ("date", ["DOB", "D.O.B", "Date of Birth", "D08"]),
        "patient.gender": ("string", ["Gender", "Sex"]),
        "patient.blood_group": ("string", ["Blood Group", "Blood Type", "BG"]),
        "patient.contact_number": ("phone", ["Contact", "Phone", "Mobile"]),
        "patient.address": ("string", ["Address", "Addr", "Residence"]),
        "visit.date": ("date", ["Date", "Visit Date", "Admission Date"]),
        "visit.time": ("time", ["Time", "Visit Time"]),
        "visit.department": ("string", ["Department", "Dept", "Ward", "Unit"]),
        "visit.reason_for_visit": ("string", ["Reason", "Chief Complaint", "CC", "Complaint", "Presenting Complaint"]),
        "vitals.blood_pressure": ("string", ["BP", "Blood Pressure", "B.P"]),
        "vitals.pulse": ("string", ["Pulse", "HR", "Heart Rate"]),
        "vitals.temperature": ("string", ["Temp", "Temperature"]),
        "vitals.weight": ("string", ["Weight", "Wt"]),
        "vitals.height": ("string", ["Height", "Ht"]),
        "insurance.provider": ("string", ["Insurer", "Insurance", "Insurance Co", "TPA"]),
        "insurance.policy_number": ("string", ["Policy No", "Policy Number", "Insurance No"]),
        "attending_physician.name": ("string", ["Doctor", "Dr", "Physician", "Consultant"]),
        "attending_physician.id": ("string", ["REGN No", "Reg No", "Doctor ID", "Physician ID"]),
    },
}
# The required paths of each domain; all others are optional.
REQUIRED = {
    "receipts": ["vendor_name", "date", "total_amount", "currency"],
    "insurance": ["policyholder.name", "policyholder.dob", "policy.policy_number", "premium.amount", "premium.currency"],
    "hospital": ["patient.name", "patient.dob", "visit.date", "visit.reason_for_visit"],
}
PREFIXES = {"receipts": "rec", "insurance": "ins", "hospital": "hosp"}
DIFFICULTIES, SPLITS, TRACKS = ["easy", "medium", "hard", "extreme"], {"train": 0.6, "dev": 0.2, "test": 0.2}, ["synthetic", "real_ocr"]
# Shares of tasks by difficulty.
TASKS = {
    "easy": {"extraction": 0.5, "normalization": 0.3, "correction": 0.1, "hallucination": 0.05, "schema": 0.05},
    "medium": {"extraction": 0.4, "normalization": 0.3, "correction": 0.15, "hallucination": 0.1, "schema": 0.05},
    "hard": {"extraction": 0.3, "normalization": 0.25, "correction": 0.2, "hallucination": 0.15, "schema": 0.1},
    "extreme": {"extraction": 0.2, "normalization": 0.2, "correction": 0.2, "hallucination": 0.25, "schema": 0.15},
}
# Fixed values of noise: counts, weights, domains, rates, amounts and added lines.
#: Noise functions drawn per tier group: (least, most) of tiers 1 and 2, of tier 3, of tier 4.
NOISE_COUNTS = {"easy": [(0, 1), (0, 0), (0, 0)], "medium": [(2, 3), (0, 1), (0, 0)], "hard": [(4, 5), (1, 2), (0, 0)], "extreme": [(5, 6), (2, 3), (1, 2)]}
NOISE_WEIGHTS = [
    {"char_O0": 8, "char_l1I": 8, "char_B8": 5, "char_S5": 5, "char_sub": 6, "char_del": 6, "char_transpose": 3, "missing_colon": 7, "merged_lines": 5, "split_line": 3, "key_abbrev": 6, "value_truncated": 4, "delimiter_swap": 3},
    {"num_comma_drop": 5, "num_decimal_shift": 3, "date_format_vary": 6, "date_partial": 4},
    {"extraneous_field": 4, "ghost_value": 3, "conflicting_field": 3, "ambiguous_key": 2, "value_swap": 4, "section_erase": 3},
]
NOISE_DOMAINS = {"char_B8": ["insurance", "hospital"], "merged_lines": ["insurance", "hospital"], "split_line": ["insurance"], "num_comma_drop": ["receipts", "insurance"], "num_decimal_shift": ["receipts"], "ghost_value": ["insurance", "hospital"]}
NOISE_RATES = {"char_O0": (0.4, 0.7), "char_l1I": (0.3, 0.6), "char_B8": (0.3, 0.5), "char_S5": (0.3, 0.5), "missing_colon": (0.3, 0.5), "key_abbrev": (0.2, 0.4), "num_comma_drop": (1.0, 1.0), "num_decimal_shift": (1.0, 1.0), "date_format_vary": (1.0, 1.0), "date_partial": (1.0, 1.0)}
#: How many characters, lines or fields the other functions change, (least, most).
NOISE_AMOUNTS = {"char_sub": (1, 2), "char_del": (1, 1), "char_transpose": (1, 1), "merged_lines": (1, 2), "split_line": (1, 1), "value_truncated": (1, 1), "delimiter_swap": (1, 2), "extraneous_field": (1, 2), "ghost_value": (1, 1), "conflicting_field": (1, 1), "ambiguous_key": (1, 1), "value_swap": (1, 1), "section_erase": (2, 4)}
EXTRA_LINES = {
    "receipts": ["Cashier: Anita", "Store ID: B-204", "Terminal: POS-12", "Loyalty Points: 42"],
    "insurance": ["Nominee: N/A", "Branch Code: 4421", "Agent Branch: MUM-07", "Scheme Code: TRML"],
    "hospital": ["Ward No: 12B", "Bed Number: 44", "Nurse: Sister Rekha", "Token No: T-089"],
}
# Identifiers that are compared with case, and the tolerance of numbers.
CASE_PATHS = ["receipt_number", "policy.policy_number", "insurance.policy_number", "attending_physician.id", "agent.agent_id"]
NUMERIC_TOLERANCE = 0.01


@dataclass(frozen=True)
class Field:
    domain: str
    path: str
    kind: str
    required: bool
    labels: tuple[str, ...]

    @property
    def section(self) -> str:
        return self.path.rpartition(".")[0]


def fields(domain: str | None = None) -> list[Field]:
    """All fields of a domain, or of all, in schema order."""
    if domain is not None and domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}")
    return [Field(d, p, kind, p in REQUIRED[d], tuple(labels)) for d, fs in DOMAINS.items() if domain in (None, d) for p, (kind, labels) in fs.items()]


def field_table(spark: SparkSession) -> DataFrame:
    """(domain, place, path, kind, required, labels): 43 rows, a size that doesn't grow."""
    rows = [(f.domain, i, f.path, f.kind, f.required, list(f.labels)) for i, f in enumerate(fields())]
    return spark.createDataFrame(rows, "domain string, place int, path string, kind string, required boolean, labels array<string>")


def label_table(spark: SparkSession) -> DataFrame:
    """(domain, label, path): lower-cased labels; where fields share a label, the later field has it."""
    found = {(f.domain, label.lower()): f.path for f in fields() for label in f.labels}
    return spark.createDataFrame([(d, label, p) for (d, label), p in found.items()], "domain string, label string, path string")


@dataclass(frozen=True)
class Settings:
    """What is checked before a run; the defaults are the settings of this module."""

    domains: dict = field(default_factory=lambda: DOMAINS)
    required: dict = field(default_factory=lambda: REQUIRED)
    tasks: dict = field(default_factory=lambda: TASKS)
    splits: dict = field(default_factory=lambda: SPLITS)
    weights: list = field(default_factory=lambda: NOISE_WEIGHTS)
    applicability: dict = field(default_factory=lambda: NOISE_DOMAINS)
    rates: dict = field(default_factory=lambda: NOISE_RATES | NOISE_AMOUNTS)
    case_paths: list = field(default_factory=lambda: CASE_PATHS)


def all_tags(weights: list[dict]) -> set[str]:
    """The names of all noise functions that have a weight."""
    return {t for tier in weights for t in tier}


def leaf_paths(domains: dict, domain: str) -> set[str]:
    """The dotted paths of a domain's leaves."""
    return set(domains[domain])


def found_faults(settings: Settings) -> list[tuple[str, bool, str]]:
    """(name, ok, what is at fault) of each check; `abbreviations` only lists short labels without an expansion, it never fails."""
    from ..functions.normalize import ABBREVIATIONS

    tags, known = all_tags(settings.weights), settings.domains
    lost = [f"{d}:{p}" for d, ps in settings.required.items() for p in ps if d not in known or p not in leaf_paths(known, d)]
    every = {p for d in known for p in leaf_paths(known, d)}
    short = {label.lower() for fs in known.values() for _, labels in fs.values() for label in labels if len(label) <= 8} - set(ABBREVIATIONS)
    short = {x for x in short if len(x) <= 4 or not x.replace(" ", "").isalpha()}
    parts = {
        "domains": sorted({"receipts", "insurance", "hospital"} ^ set(known)),
        "noise_applicability": sorted(set(settings.applicability) - tags),
        "noise_rates": sorted(tags - set(settings.rates)),
        "required_fields": lost,
        **{f"tasks_{d}": [] if abs(sum(w.values()) - 1) < 1e-9 else [str(sum(w.values()))] for d, w in settings.tasks.items()},
        "splits": [] if abs(sum(settings.splits.values()) - 1) < 1e-9 else [str(sum(settings.splits.values()))],
        "case_paths": sorted(set(settings.case_paths) - every),
    }
    return [*((name, not faults, ",".join(faults)) for name, faults in parts.items()), ("abbreviations", True, ",".join(sorted(short)))]


def checks(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """(name, ok, detail) of the settings."""
    return spark.createDataFrame(found_faults(settings or Settings()), "name string, ok boolean, detail string")


def run_checks(settings: Settings | None = None) -> int:
    """Prints every check and returns an exit code: 0 if all hold."""
    found = found_faults(settings or Settings())
    for name, ok, detail in found:
        print(f"{'ok  ' if ok else 'FAIL'} {name} {detail}".rstrip())
    return int(not all(ok for _, ok, _ in found))


def required_paths() -> Column:
    """A map of domain to required paths, as a literal."""
    return F.create_map(*[x for d in DOMAINS for x in (F.lit(d), F.array(*[F.lit(f.path) for f in fields(d) if f.required]))])


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Settings from a JSON file (any path that Spark reads); what the file doesn't name keeps its default."""
    text = spark.read.text(path, wholetext=True).head()[0]
    found = json.loads(text)
    known = {f.name for f in fields_of(Settings)}
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown settings {', '.join(unknown)}")
    return Settings(**found)
