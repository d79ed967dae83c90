"""Secret scans with DataFrame functions only: three kinds of patterns, and sliding-window Shannon entropy.

Patterns (`assign`, `access`, `hex`) find what has a known shape. For the rest, long runs of token characters are
candidates: a window of `window` characters slides over each, per character class, with counts of its characters that
change by the one that enters and the one that leaves; where the window's entropy reaches the class's bound, the
run is a span of kind `entropy_b64` or `entropy_hex`. Runs that hold an allow-listed string or overlap a span of the three
patterns are left out, or with `parts` only what is allow-listed or in such a span; spans of the three patterns are never left out.

A null text counts as empty: no spans. Repeated rows have equal spans; an empty table gives no rows. Offsets are code points, ends exclusive. Texts may have any length; everything is
per row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

# Fixed values of the scan: patterns and the least length of what counts.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "entropy_b64", "entropy_hex")

#: Candidates: runs of so many characters of these classes.
WINDOW = 20
CLASSES = {
    "entropy_b64": {"run": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "needs": ("[0-9]", "[A-Z]", "[a-z]"), "alphabet": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "bits": 3.8},
    "entropy_hex": {"run": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", "needs": ("[0-9]", "[A-Fa-f]"), "alphabet": "0123456789abcdefABCDEF", "bits": 3.0},
}
#: A run that holds one of these, in any letter case, is no secret.
ALLOW = ("example", "placeholder", "changeme", "dummy", "sample", "xxxxxxxx", "00000000", "0123456789", "abcdefgh")


#: Matches that are numbered together, so that many in one text don't copy each other over and over.
RUN = 256


def matches(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches `found`, in order.

    The texts between matches give the offsets: a match starts after all pieces and matches before it. Runs of RUN matches are
    placed by themselves, and then moved by what the runs before them take.
    """
    spans = "array<struct<start:bigint,end:bigint,found:string>>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        new = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(new)).alias("out"))

    def move(state: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end"), x["found"].alias("found")))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def placed(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(RUN)), first, step))
        return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{spans}>").alias("out")), move, lambda s: F.flatten(s["out"]))

    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("found"))
    return F.transform(F.array(pairs), placed)[0]  # bound once, however many runs read it


def weight(n: int) -> int:
    """Millionths of n log2(n); whole numbers add up the same in any order."""
    import math

    return round(1e6 * n * math.log2(n)) if n > 1 else 0


def least_weight(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The least sum of c log2 c (millionths) over all windows of the run; null for a run shorter than a window.

    The state holds the counts of the alphabet's characters, the sum, and the least sum so far. A step adds the
    character that enters, takes off the one that leaves, and changes the sum by what those two counts change.
    """
    table = F.array(*[F.lit(weight(n)).cast("long") for n in range(window + 2)])
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)).alias("leaves"), i.alias("i")))
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("long").alias("least"),
    )

    def step(s: Column, x: Column) -> Column:
        n_in = F.get(s["counts"], x["enters"])
        n_out = F.get(s["counts"], x["leaves"])
        changed = F.get(table, n_in + 1) - F.get(table, n_in) + F.coalesce(F.get(table, n_out - 1) - F.get(table, n_out), F.lit(0))
        total = s["sum"] + F.when(x["enters"] == x["leaves"], F.lit(0)).otherwise(changed)
        counts = F.transform(s["counts"], lambda c, k: c + (k == x["enters"]).cast("int") - (k == x["leaves"]).cast("int"))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(x["i"] >= window - 1, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

    return F.aggregate(steps, start, step, lambda s: s["least"])


def weight_bound(bits: float, window: int = WINDOW) -> int:
    """Entropy is log2(window) - sum(c log2 c) / window: it reaches `bits` where the sum is at most this."""
    import math

    return math.floor(1e6 * window * (math.log2(window) - bits))


def blanked(text: Column, spans: Column) -> Column:
    """text with blanks, one for each character, over the spans and the allow-listed strings; offsets stay."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        between = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        blanks = F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], s["at"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(between, blanks)).alias("out"))

    out = F.aggregate(F.array_sort(spans), empty, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    for piece in ALLOW:
        out = F.regexp_replace(out, "(?i)" + piece, " " * len(piece))
    return out


def find_secrets(df: DataFrame, text_col: str = "text", parts: bool = False) -> DataFrame:
    """df with `secrets` array<struct<start long, end long, kind string>>, by start, then kind as in KINDS, then end.

    A column of that name is replaced; any other name is kept. parts: a run that spans of the three patterns or allow-listed strings touch isn't left
    out; what they leave of it are candidates of their own.
    """
    none = F.array().cast("array<string>")
    spans_of = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    given = [c for c in df.columns if c != "secrets"]
    moved, _ = aside(df.select(*[F.col(f"`{c}`") for c in given]), ["_base", "_free", *[f"_{k}" for k in KINDS]])
    names = dict(zip(given, moved.columns))
    text = F.coalesce(F.col(f"`{names[text_col]}`").cast("string"), F.lit(""))
    staged = moved.withColumns({
        "_assign": F.when(text.rlike(ASSIGN_HINT), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))).otherwise(none),
        "_access": F.when(F.contains(text, F.lit("AKIA")), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(none),
        "_hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        **{f"_{kind}": F.regexp_extract_all(text, F.lit(c["run"]), F.lit(0)) for kind, c in CLASSES.items()},
    })
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {kind: c["run"] for kind, c in CLASSES.items()}
    staged = staged.withColumns({f"_{kind}": F.when(F.size(f"_{kind}") == 0, spans_of.cast("array<struct<start:bigint,end:bigint,found:string>>")).otherwise(matches(text, F.col(f"_{kind}"), p)) for kind, p in patterns.items()})
    keep = {"assign": lambda x: F.length(F.regexp_replace(x["found"], ASSIGN_HEAD, "")) >= ASSIGN_LEAST}

    def named(kind: str) -> Column:
        spans = F.col(f"_{kind}")
        if kind in keep:
            spans = F.filter(spans, keep[kind])
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    staged = staged.withColumn("_base", F.concat(*[named(k) for k in ("assign", "access", "hex")]))

    if parts:
        runs = F.lit(False)
        for kind in CLASSES:
            runs = runs | (F.size(f"_{kind}") > 0)
        touched = runs & ((F.size("_base") > 0) | text.rlike("(?i)" + "|".join(ALLOW)))
        staged = staged.withColumn("_free", F.when(touched, blanked(text, F.col("_base"))))
        again = lambda run: matches(F.col("_free"), F.regexp_extract_all("_free", F.lit(run), F.lit(0)), run)
        staged = staged.withColumns({f"_{kind}": F.when(F.col("_free").isNull(), F.col(f"_{kind}")).otherwise(again(c["run"])) for kind, c in CLASSES.items()})

    def random_runs(kind: str) -> Column:
        c = CLASSES[kind]

        def keeps(x: Column) -> Column:
            run = x["found"]
            ok = F.lit(True) if parts else ~run.rlike("(?i)" + "|".join(ALLOW)) & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            for need in c["needs"]:
                ok = ok & run.rlike(need)
            return F.when(ok, least_weight(run, c["alphabet"]) <= weight_bound(c["bits"])).otherwise(F.lit(False))

        return F.transform(F.filter(F.col(f"_{kind}"), keeps), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat("_base", *[random_runs(k) for k in CLASSES])
    ranked = F.array_sort(F.transform(every, lambda x: F.struct(x["start"], F.array_position(order, x["kind"]).alias("rank"), x["end"], x["kind"])))
    out = staged.withColumn("secrets", F.transform(ranked, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return out.select(*[F.col(f"`{names[c]}`").alias(c) for c in given], "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """text with each stretch that spans cover, overlapping ones joined, replaced."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(by))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, empty, step, rest))
