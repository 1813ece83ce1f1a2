"""Secrets in text: fixed patterns, and windows of high Shannon entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import let, whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
# Greedy runs of one class: asking for the length finds the same leftmost matches as
# dropping the shorter ones afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
# Character class of a candidate, window and least length, least entropy in bits: first class that fits.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 16, 3.0),
    (r"^[A-Z0-9]+$|^[a-z0-9]+$", 20, 3.4),
    (r"^[A-Za-z0-9]+$", 20, 3.8),
    (r".", 24, 3.9),
)
# Harmless shapes: identifiers, names with a short number, numbers.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[^A-Za-z]+$",
)
NAME = r"^[A-Za-z+/_=-]+[0-9]{0,4}$"
# A placeholder excuses the part it stands in, between delimiters; a longer part holds one by chance.
PLACEHOLDER = r"(?i)(?<![a-z0-9])[a-z0-9]{0,24}(?:example|sample|placeholder|dummy|changeme|xxxx|0123456|abcdefg)[a-z0-9]{0,24}(?![a-z0-9])"
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
# Matches scanned at once, and characters of a candidate: arrays and strings that grow stay this short.
GROUP = 512
PIECE = 256


def running(items: Column, zero: Column, advance, emit, kind: str) -> Column:
    """emit(state, item) of every item, an array of `kind`, where advance(state, item) gives the next one's state.

    The states at the heads of groups come first, so that no array grows with every item.
    """
    none = F.array().cast(f"array<{kind}>")
    heads = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(GROUP))).otherwise(F.array().cast("array<int>"))

    def scan(groups: Column) -> Column:
        states = F.aggregate(
            groups,
            F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, g: F.struct(F.aggregate(g, s["at"], advance).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        step = lambda s, x: F.struct(advance(s["at"], x).alias("at"), F.concat(s["out"], F.array(emit(s["at"], x).cast(kind))).alias("out"))
        inside = lambda at: lambda g, i: F.aggregate(g, F.struct(F.get(at, i).alias("at"), none.alias("out")), step, lambda s: s["out"])
        return let(states, lambda at: F.flatten(F.transform(groups, inside(at))))

    return let(F.transform(heads, lambda k: F.slice(items, k, F.lit(GROUP))), scan)


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Code point spans of the leftmost non-overlapping matches.

    Places follow from the lengths of the matches and of the texts between them. Texts
    without a match skip the work.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    zipped = F.zip_with(
        F.zip_with(between, found, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h"))),
        last,
        lambda p, g: F.struct(p["g"].alias("g"), p["h"].alias("h"), g.alias("last")),
    )

    def emit(at: Column, one: Column) -> Column:
        begin = at + one["g"]
        end = begin + F.length(one["h"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.when(one["h"].isNotNull() & (keep(one["last"]) if keep else F.lit(True)), span)

    def advance(at: Column, one: Column) -> Column:
        return at + one["g"] + F.coalesce(F.length(one["h"]), F.lit(0))

    placed = let(zipped, lambda items: F.filter(running(items, F.lit(0), advance, emit, SPAN), lambda s: s.isNotNull()))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def peak_in_piece(text: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of a window of a short text.

    With counts c of the characters it is log2(w) - sum(c * log2(c)) / w. Moving the window
    by one changes two counts, so the sum is carried on.
    """
    weight = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    occurs = lambda part, c: F.length(part) - F.length(F.replace(part, c, F.lit("")))
    first = F.substring(text, 1, window)
    begin = F.aggregate(
        F.array_distinct(F.split(first, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(weight(occurs(first, c)))
    )

    def step(state: Column, k: Column) -> Column:
        held, out, new = F.substr(text, k, F.lit(window)), F.substr(text, k, F.lit(1)), F.substr(text, k + window, F.lit(1))
        gone = occurs(held, out)
        came = occurs(held, new) - F.when(out == new, 1).otherwise(0)
        total = state["s"] - weight(gone) + weight(gone - 1) - weight(came) + weight(came + 1)
        return F.struct(total.alias("s"), F.least(state["best"], total).alias("best"))

    moves = F.length(text) - window
    steps = F.when(moves > 0, F.sequence(F.lit(1), F.greatest(moves, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    lowest = let(begin, lambda s: F.aggregate(steps, F.struct(s.alias("s"), s.alias("best")), step, lambda a: a["best"]))
    return F.log2(F.lit(float(window))) - lowest / window


def peak_entropy(text: Column, window: int) -> Column:
    """The highest entropy of a window of a candidate, 0 if it is shorter than the window.

    Pieces of bounded length, each with the characters that its last windows need, keep the
    work in proportion to the candidate.
    """

    def best(cut: Column) -> Column:
        more = lambda i: F.coalesce(F.substring(F.get(cut, i + 1), 1, window - 1), F.lit(""))
        pieces = F.filter(F.transform(cut, lambda c, i: F.concat(c, more(i))), lambda p: F.length(p) >= window)
        return F.coalesce(F.array_max(F.transform(pieces, lambda p: peak_in_piece(p, window))), F.lit(0.0))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), best)


def suspicious(text: Column) -> Column:
    """Whether a candidate, without parts that hold a placeholder, reaches its class's entropy.

    Letters with at most four digits behind them are a name, unless a quarter of them are
    capitals and a quarter are not.
    """

    def judged(rest: Column) -> Column:
        size, small, capital = F.length(rest), F.length(F.regexp_replace(rest, "[^a-z]+", "")), F.length(F.regexp_replace(rest, "[^A-Z]+", ""))
        # Paths of short lower-case names are harmless too.
        allowed = rest.rlike("^[a-z0-9_/-]+$") & rest.contains("/") & ~rest.rlike("[^/]{13,}")
        allowed = allowed | (rest.rlike(NAME) & ((4 * small < size) | (4 * capital < size)))
        for pattern in ALLOWED:
            allowed = allowed | rest.rlike(pattern)
        verdict = None
        for shape, window, least in CLASSES:
            fits, high = rest.rlike(shape), peak_entropy(rest, window) >= least
            verdict = F.when(fits, high) if verdict is None else verdict.when(fits, high)
        return F.when(allowed, False).otherwise(verdict.otherwise(False))

    return F.when(text.isNull(), False).otherwise(let(F.regexp_replace(text, PLACEHOLDER, ""), judged))


def rendered(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every whole text.

    A null or empty text has no spans, and the hash is that of the empty text. Entropy
    spans that lie wholly in a base span are left out. Repeated rows are answered each. Work
    grows with the length of a text and the number of its matches.
    """
    text = whole(F.col("text"))
    base = docs.select(
        "doc_id",
        spans(text, ASSIGN, "assign", lambda g: F.length(F.coalesce(g, F.lit(""))) >= ASSIGN_LENGTH).alias("_a"),
        spans(text, ACCESS, "access").alias("_k"),
        spans(text, HEX, "hex").alias("_x"),
        candidate_spans(text).alias("_e"),
    )
    base = base.withColumn("_base", F.array_sort(F.concat("_a", "_k", "_x")))
    base = base.withColumn("_new", F.when(F.size("_e") > 0, outside("_base", "_e")).otherwise(F.col("_e")))
    return base.select(
        "doc_id",
        F.size("_a").cast("long").alias("n_assign"),
        F.size("_k").cast("long").alias("n_access"),
        F.size("_x").cast("long").alias("n_hex"),
        F.sha2(rendered(F.col("_base")), 256).alias("base_sha256"),
        rendered(F.array_sort(F.concat("_base", "_new"))).alias("spans"),
        F.size("_new").cast("long").alias("n_entropy"),
    )


def outside(base: str, found: str) -> Column:
    """The `found` spans that no `base` span contains: none that begins no later reaches as far."""
    fresh = lambda reach, s: F.when((s["rank"] == KINDS.index("entropy")) & (s["end"] > reach), s)
    reach = lambda reach, s: F.when(s["rank"] < KINDS.index("entropy"), F.greatest(reach, s["end"])).otherwise(reach)
    kept = lambda items: F.filter(running(items, F.lit(0), reach, fresh, SPAN), lambda s: s.isNotNull())
    return let(F.array_sort(F.concat(base, found)), kept)


def candidate_spans(text: Column) -> Column:
    """Candidate strings whose class's entropy is reached and that no allowed shape explains."""
    return spans(text, f"()({CANDIDATE})", "entropy", suspicious)
