"""Operator 6: secret scans: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Three kinds are found by pattern: `assign`, `access` and `hex`. The method adds `random`: of the text that these leave, runs
of at least MIN_LENGTH characters of the base64 alphabets that mix kinds of characters (runs of one case are words to every
test). Each run's encoding is inferred (the smallest alphabet that has all its characters), and the battery looks at it:
chi-squared uniformity of its symbols, runs (above and below the middle of the alphabet, and of kinds of characters), and
serial correlation at lag 1. The battery is held against two hypotheses. A run that looks random in its encoding is one
that no test rejects (Bonferroni, level LEVEL). Its p-value is the battery's against text: text repeats symbols, which the
chi-squared statistic counts, and keeps to a kind of characters, which the number of runs counts; what each of these
statistics has beyond its mean for text is added up. A short run cannot make that small. The false-discovery rate is held
at RATE within each stratum of lengths (powers of two) by Benjamini and Hochberg's rule. P-values are counted in steps
of a tenth of a power of ten, so the rule needs a count for each step and no sort, and they are bounds (exp(-z^2/2)/2),
so it is kept.

Texts are scanned twice, whole: to count p-values, then to report. Offsets count code points, ends excluded. Null texts
count as empty. Rows, repeated ones too, are kept one for one with all their columns. Nothing is shuffled but counts of
steps. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import fresh, quoted, whole_text

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, LEVEL, RATE, STEPS = 16, 0.001, 0.01, 300

#: The three patterns. Of a run of letters and digits the leftmost match takes all, so those lengths can
#: stand in the pattern; an assignment with a short value takes its place all the same, so its length is looked at after.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
RANDOM = r"[A-Za-z0-9+/_=-]{" + str(MIN_LENGTH) + ",}"
MIXED = "[0-9]|[a-z][A-Z]"

#: Encodings, the smallest first: name, what its runs match, its alphabet.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("upper36", "^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("lower36", "^[a-z0-9]+$", _LOWER + _DIGITS),
    ("base52", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^.*$", _UPPER + _LOWER + _DIGITS + "-_+/"),
]
#: Of text and identifiers: the chance that two symbols are equal (the index of coincidence of English letters), and that
#: neighbours differ in kind (case, digit, mark; well beyond that of prose, as identifiers change more often).
SAME, CHANGE = 0.066, 0.15


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches (start, end, value) of a pattern, leftmost first and apart; value is the group.

    The gaps between matches and the matches make up the text, so running sums of their lengths give the offsets.
    They are summed in blocks, which keeps the work for n matches well under n squared."""
    block = 256
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")] if group else []

    def spans(parts: Column) -> Column:
        lengths = parts["lengths"]
        firsts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda c: F.slice(lengths, c * block + 1, F.lit(block)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["list"], acc["at"]).alias("list"))
        sums = F.transform(firsts, lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n))
        bases = F.aggregate(sums, zero, step)["list"]
        starts = F.flatten(F.zip_with(firsts, bases, lambda part, base: F.transform(F.aggregate(part, zero, step)["list"], lambda at: at + base)))
        return F.transform(
            F.arrays_zip(starts.alias("at"), parts["gaps"].alias("gap"), parts["found"].alias("hit"), parts["value"].alias("value")),
            lambda x: F.struct((x["at"] + F.length(x["gap"])).alias("start"), (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["value"].alias("value")),
        )

    def parts(x: Column) -> Column:
        before = F.slice(x["gaps"], F.lit(1), F.size(x["found"]))
        return F.struct(F.zip_with(before, x["found"], lambda g, f: F.length(g) + F.length(f)).alias("lengths"), before.alias("gaps"), x["found"].alias("found"), x["value" if group else "found"].alias("value"))

    # One-element arrays bind what the next step needs, so that it is computed once.
    spans_of = F.transform(F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"), *value)), parts), spans)[0]
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), spans_of).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """A bound of the normal tail: ten times its negative decimal logarithm, as a whole number of steps."""
    return F.when(z > 0, F.least(F.lit(float(STEPS)), 10 * (F.lit(0.30103) + z * z / 2 * 0.4342944819))).otherwise(0.0)


def weighed(token: Column) -> Column:
    """(encoding, random, step): whether no test rejects randomness, and the p-value against text as -10 log10, rounded down."""
    n = F.length(token).cast("double")
    alphabet = F.coalesce(*(F.when(token.rlike(p), F.lit(a)) for _, p, a in ENCODINGS))
    name = F.coalesce(*(F.when(token.rlike(p), F.lit(e)) for e, p, _ in ENCODINGS))

    def measured(x: Column) -> Column:
        size = F.length(x["alphabet"]).cast("double")
        # Symbols that the alphabet lacks (padding) count as its first.
        codes = F.transform(F.filter(F.split(x["token"], ""), lambda c: c != ""), lambda c: F.greatest(F.lit(0), F.instr(x["alphabet"], c) - 1).cast("double"))
        squares = F.aggregate(
            F.transform(F.split(x["alphabet"], ""), lambda c: (F.length(x["token"]) - F.length(F.replace(x["token"], c, F.lit("")))).cast("double")),
            F.lit(0.0), lambda a, c: a + F.when(c > 0, c * c).otherwise(0.0),
        )
        collapsed = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["token"], "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[+/_=-]+", "+"))
        return F.struct(x["name"].alias("name"), F.length(x["token"]).cast("double").alias("n"), size.alias("size"), codes.alias("codes"), squares.alias("squares"), (collapsed - 1).cast("double").alias("changes"))

    def judged(m: Column) -> Column:
        n, size, codes = m["n"], m["size"], m["codes"]
        degrees = size - 1
        uniform = (size / n * m["squares"] - n - degrees) / F.sqrt(2 * degrees * (n - 1) / n)
        high = F.transform(codes, lambda c: F.when(c >= size / 2, 1.0).otherwise(0.0))
        highs = F.aggregate(high, F.lit(0.0), lambda a, h: a + h)
        lows = n - highs
        runs = 1 + F.aggregate(F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, d: a + d)
        pairs = 2 * highs * lows
        spread = pairs * (pairs - n) / (n * n * (n - 1))
        run_z = F.when(spread > 0, (runs - pairs / n - 1) / F.sqrt(spread)).otherwise(99.0)
        total = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c)
        power = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c)
        lagged = F.aggregate(F.zip_with(codes, F.concat(F.slice(codes, F.lit(2), F.size(codes) - 1), F.slice(codes, F.lit(1), F.lit(1))), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
        variance = n * power - total * total
        serial = F.when(variance > 0, (n * lagged - total * total) / F.when(variance > 0, variance).otherwise(1.0)).otherwise(1.0)
        serial_z = (serial + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        worst = F.greatest(F.abs(uniform), F.abs(run_z), F.abs(serial_z))
        limit = F.lit(3.588)  # two-sided normal quantile of LEVEL / 3
        expected = SAME * n * (n - 1) / 2
        fewer = (expected - (m["squares"] - n) / 2) / F.sqrt(1.5 * expected)
        more = (m["changes"] - CHANGE * (n - 1)) / F.sqrt(CHANGE * (1 - CHANGE) * (n - 1))
        return F.struct(m["name"].alias("encoding"), (worst < limit).alias("random"), F.floor(_upper_tail((fewer + more) / F.sqrt(F.lit(2.0)))).cast("int").alias("step"), F.floor(F.log2(n)).cast("int").alias("stratum"))

    bound = F.array(F.struct(token.alias("token"), alphabet.alias("alphabet"), name.alias("name")))
    return F.transform(F.transform(bound, measured), judged)[0]


def _blanked(text: Column, pattern: str, least: int = 0) -> Column:
    """The text with blanks for each match, if group 2 has `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    blank = F.transform(found, lambda f: F.repeat(F.lit(" "), F.length(f)))
    if least:
        blank = F.zip_with(F.arrays_zip(found.alias("f"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v")), blank, lambda x, b: F.when(F.length(x["v"]) >= least, b).otherwise(x["f"]))
    out = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(blank)), blank, lambda g, b: F.concat(g, b)), ""), F.element_at(gaps, -1))
    return F.when(text.rlike(pattern), out).otherwise(text)


def _with_rest(docs: DataFrame, text: str, rest: str) -> DataFrame:
    """`docs` with a column `rest`: the text with blanks for what the patterns find."""
    out = docs.withColumn(rest, _blanked(F.col(text), PATTERNS["assign"], 6))
    for kind in ("access", "hex"):
        out = out.withColumn(rest, _blanked(F.col(rest), PATTERNS[kind]))
    return out


def _candidates(rest: Column) -> Column:
    """Runs and what weighed() says of them. Most texts have none, which takes no offsets to see."""
    runs = F.filter(_hits(rest, RANDOM), lambda h: h["value"].rlike(MIXED))
    found = F.transform(runs, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), weighed(h["value"]).alias("t")))
    mixed = rest.rlike(MIXED) & F.exists(F.regexp_extract_all(rest, F.lit(RANDOM), F.lit(0)), lambda v: v.rlike(MIXED))
    none = F.array().cast("array<struct<start:int,end:int,t:struct<encoding:string,random:boolean,step:int,stratum:int>>>")
    return F.when(mixed, found).otherwise(none)


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[int, int]:
    """The least step that counts as a discovery in each stratum; strata without any have none. At most 32 entries."""
    rest = _with_rest(docs.select(whole_text(text_col).alias("text")), "text", "rest")
    found = rest.select(F.explode(F.transform(_candidates(F.col("rest")), lambda c: c["t"])).alias("t"))
    steps = found.groupBy("t.stratum", F.when(F.col("t.random"), F.col("t.step")).otherwise(-1).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for stratum in {r["stratum"] for r in steps}:
        own = sorted(((r["step"], r["n"]) for r in steps if r["stratum"] == stratum), reverse=True)  # STEPS + 2 at most
        tested, above = sum(n for _, n in own), 0
        for step, n in own:
            above += n
            if step > 0 and 10 ** (-step / 10) * tested <= rate * above:
                out[stratum] = step
    return out


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", rate: float = RATE) -> DataFrame:
    """`docs` with one more column: an array of (start, end, kind), by start, then as KINDS lists them. `docs` is read twice."""
    least = thresholds(docs, text_col, rate)
    text, base, rest, found = (fresh(docs, f"__{x}") for x in ("text", "base", "rest", "found"))
    kinds = {k: i for i, k in enumerate(KINDS)}
    kept = lambda hits, kind: F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kinds[kind]).alias("kind"), h["end"].alias("end")))
    plain = docs.withColumn(text, whole_text(text_col))
    t = F.col(text)
    assign = F.filter(_hits(t, PATTERNS["assign"], 2), lambda h: F.length(h["value"]) >= 6)
    plain = plain.withColumn(base, F.concat(kept(assign, "assign"), kept(_hits(t, PATTERNS["access"]), "access"), kept(_hits(t, PATTERNS["hex"]), "hex")))
    if least:
        at = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
        beyond = lambda c: c["t"]["random"] & (c["t"]["step"] >= F.coalesce(F.try_element_at(at, c["t"]["stratum"]), F.lit(STEPS + 1)))
        apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        plain = _with_rest(plain, text, rest).withColumn(found, F.filter(_candidates(F.col(rest)), beyond))
        plain = plain.withColumn(found, F.concat(base, kept(F.filter(found, apart), "random"))).drop(rest)
    else:
        plain = plain.withColumn(found, F.col(base))
    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["kind"]].alias("kind")))
    return plain.withColumn(spans_col, ordered).drop(text, base, found)


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", by: str = "[SECRET]") -> DataFrame:
    """`docs` with `by` in place of each stretch of text that spans cover; texts without spans, null ones too, stay as they are."""
    text, spans = F.col(quoted(text_col)), F.col(quoted(spans_col))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.when(new, F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(new, F.lit(by)).otherwise("")).alias("out"))

    done = F.transform(F.array(F.aggregate(spans, zero, step)), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))[0]
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))
