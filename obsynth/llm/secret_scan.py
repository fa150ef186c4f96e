"""Secrets in texts by patterns and by sliding-window entropy, in DataFrame functions alone.

Four pattern-free steps beside three patterns: runs of one character class are candidate strings;
a window slides over each, and its Shannon entropy follows from counts that change by one character
in and one out per step (kept in integers: sums of n * log2 n scaled by 2**20, so nothing drifts);
a candidate with a window above the class's threshold is a span.  Stretches that the allow list
names are cut out first: a window that overlaps one doesn't count, the rest of the candidate does.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the numbered query: fixed values of its contract.  ``group`` and ``least`` say
# which group must have how many characters; the order of kinds breaks ties of the start.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]

SCALE = 1 << 20
STEP = 256  # matches added up at a time when positions are summed
# Strings that look random but are not: alphabets, placeholders, universally unique ids.
ALLOWED = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|abcdefgh|12345678|qwerty|example|placeholder|changeme|(.)\1{5,}"
MIXED = r"(?:[0-9].*[A-Za-z]|[A-Za-z].*[0-9])"


@dataclass(frozen=True)
class CharClass:
    """A character class: its letters, the window, and the entropy in bits that a window must reach."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + self.alphabet.replace("-", "") + ("-" if "-" in self.alphabet else "") + "]{" + str(self.window) + ",}"

    def most(self) -> int:
        """Largest scaled sum of n * log2 n that still has the entropy."""
        return int(SCALE * self.window * (log2(self.window) - self.bits))

    def costs(self) -> list[int]:
        return [round(SCALE * n * log2(n)) if n else 0 for n in range(self.window + 1)]


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = [CharClass("entropy_hex", DIGITS + UPPER[:6] + LOWER[:6], 20, 2.97), CharClass("entropy_base64", DIGITS + UPPER + LOWER + "+/_=-", 20, 3.87)]


def running(xs: Column) -> Column:
    """Sums of all elements before each element.  Blocks of ``STEP`` are summed first, so the work
    grows with the number of elements rather than its square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int")), lambda b: F.slice(xs, b * STEP + 1, STEP))

    def prefix(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    total = lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)
    inner = F.zip_with(blocks, prefix(F.transform(blocks, total), F.lit(0)), lambda b, s: F.when(b.isNotNull(), F.slice(prefix(b, s), 1, F.size(b))).otherwise(F.array().cast("array<int>")))
    return F.when(F.size(xs) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def high_entropy(text: Column, kind: CharClass) -> Column:
    """Whether some window of the string (of the class's letters alone) has the class's entropy."""
    costs = F.array(*(F.lit(c).cast("long") for c in kind.costs()))
    start = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit("").alias("window"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("hit")
    )

    def step(acc: Column, letter: Column) -> Column:
        here = F.instr(F.lit(kind.alphabet), letter)
        full = F.char_length(acc["window"]) == kind.window
        gone = F.when(full, F.instr(F.lit(kind.alphabet), F.substring(acc["window"], 1, 1))).otherwise(0)
        n_gone = F.when(full, F.get(acc["counts"], gone - 1)).otherwise(0)
        n_here = F.get(acc["counts"], here - 1) - F.when(here == gone, 1).otherwise(0)
        less = F.when(full, F.get(costs, n_gone - 1) - F.get(costs, n_gone)).otherwise(F.lit(0).cast("long"))
        total = acc["sum"] + less + F.get(costs, n_here + 1) - F.get(costs, n_here)
        window = F.concat(F.when(full, F.substring(acc["window"], 2, kind.window)).otherwise(acc["window"]), letter)
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == here, 1).otherwise(0) - F.when(i + 1 == gone, 1).otherwise(0))
        hit = acc["hit"] | ((F.char_length(window) == kind.window) & (total <= kind.most()))
        return F.struct(counts.alias("counts"), window.alias("window"), total.alias("sum"), hit.alias("hit"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["hit"])


def _spans(text: str, pattern: str, number: int, pieces: str, found: str, values: Column, keep) -> Column:
    """Sorted (start, kind, end) of the matches of a pattern that ``keep`` accepts.  The text between
    matches (``pieces``) and the matches (``found``) give positions in code points."""
    gap = F.transform(F.slice(F.col(pieces), 1, F.size(found)), F.char_length)
    size = F.transform(F.col(found), F.char_length)
    starts = F.zip_with(running(F.zip_with(gap, size, lambda a, b: a + b)), gap, lambda s, g: s + g)
    spans = F.zip_with(starts, size, lambda s, n: F.struct(s.alias("start"), F.lit(number).alias("kind"), (s + n).alias("end")))
    both = F.arrays_zip(spans.alias("span"), values.alias("value"))
    return F.transform(F.filter(both, lambda x: keep(x["value"])), lambda x: x["span"])


def find_secrets(docs: DataFrame, text_col: str = "text", classes: list[CharClass] = CLASSES) -> DataFrame:
    """``docs`` (whose column names do not start with an underscore and a letter of p, m, v, s) with
    ``_base`` and ``_all``: arrays of (start, kind, end) of
    the base patterns and of all spans, sorted; kinds are numbered in the order of ``kinds``.

    A null or empty text has no spans, very long ones are read whole.  Every row is judged alone, so repeated rows, null ids and any
    other columns make no difference; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    rules = [(k, p, g, lambda v, n=n: F.char_length(v) >= n) for k, p, g, n in BASE]
    rules += [(c.kind, c.pattern, 0, lambda v, c=c: F.exists(F.split(v, ALLOWED), lambda x: (F.char_length(x) >= c.window) & x.rlike(MIXED) & high_entropy(x, c))) for c in classes]
    none = F.array().cast("array<string>")
    for i, (_, pattern, group, keep) in enumerate(rules):
        hit = text.rlike(pattern)
        out = out.withColumns(
            {f"_p{i}": F.when(hit, F.split(text, pattern, -1)).otherwise(none), f"_m{i}": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)}
            | ({f"_v{i}": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)} if group else {})
        )
    for i, (_, pattern, group, keep) in enumerate(rules):
        values = F.col(f"_v{i}" if group else f"_m{i}")
        out = out.withColumn(f"_s{i}", F.when(F.size(f"_m{i}") > 0, _spans(text_col, pattern, i, f"_p{i}", f"_m{i}", values, keep)).otherwise(F.array().cast(SPANS)))
    n = len(BASE)
    out = out.withColumns({"_base": F.array_sort(F.concat(*(F.col(f"_s{i}") for i in range(n)))), "_all": F.array_sort(F.concat(*(F.col(f"_s{i}") for i in range(len(rules)))))})
    return out.drop(*(f"_{x}{i}" for x in "pmvs" for i in range(len(rules))))


SPANS = "array<struct<start: int, kind: int, end: int>>"


def kinds(classes: list[CharClass] = CLASSES) -> list[str]:
    return [k for k, *_ in BASE] + [c.kind for c in classes]


def span_text(spans: Column, classes: list[CharClass] = CLASSES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds(classes)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: list[CharClass] = CLASSES) -> DataFrame:
    """Per row: doc_id, numbers of base spans by kind, digest of the base spans, all spans as text."""
    d = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), classes=classes)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)), F.sha2(span_text(F.col("_base"), classes), 256).alias("base_sha256"), span_text(F.col("_all"), classes).alias("spans")
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", classes: list[CharClass] = CLASSES) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; null stays null."""
    d = find_secrets(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text")), classes=classes)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["parts"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

    masked = F.aggregate(F.col("_all"), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.char_length("text"))))
    text = F.when(F.size("_all") > 0, masked).otherwise(F.col("text"))
    return d.select(*((text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def _sql_either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def report_sql(classes: list[CharClass] = CLASSES) -> str:
    """The report in DuckDB SQL, with window entropies taken anew for every window."""
    words = "|".join(_sql_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    quote = "[\"'']"
    patterns = [f"({words}){quote}?\\x20*[:=]\\x20*{quote}?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+", *(c.pattern for c in classes)]
    allowed = "(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$|abcdefgh|12345678|qwerty|example|placeholder|changeme|" + "|".join(f"{c}{{6,}}" for c in DIGITS + LOWER + "/_=-") + r"|\+{6,}"
    one = []
    for i, p in enumerate(patterns):
        group = 2 if i == 0 else 0
        if i < len(BASE):
            keep = f"len(v) >= {BASE[i][3]}"
        else:
            c = classes[i - len(BASE)]
            entropy = f"list_max(list_transform(range(1, len(x) - {c.window - 2}), lambda k: list_aggregate(string_split(substr(x, k, {c.window}), ''), 'entropy')))"
            keep = f"len(list_filter(string_split_regex(v, '{allowed}'), lambda x: len(x) >= {c.window} and regexp_matches(x, '{MIXED}') and {entropy} >= {c.bits})) > 0"
        one.append(
            f"""select n, {i} as kind, start, start + size as stop from (
                select n, v, size, sum(gap + size) over (partition by n order by k rows between unbounded preceding and current row) - size as start from (
                    select n, k, len(p[k]) as gap, len(m[k]) as size, g[k] as v from (
                        select n, unnest(range(1, len(m) + 1)) as k, m, g, p from (
                            select n, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {group}) as g, string_split_regex(text, '{p}') as p from d))))
                where {keep}"""
        )
    names = "[" + ", ".join(f"'{k}'" for k in kinds(classes)) + "]"
    label = f"{names}[kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint)"
    return f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
s as ({' union all '.join(one)}),
a as (select n, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg({label}, ',' order by start, kind) filter (kind < {len(BASE)}) as base, string_agg({label}, ',' order by start, kind) as spans from s group by n)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (n)
"""
