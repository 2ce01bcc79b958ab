"""Secret scans with multipart credential linking, in DataFrame functions only.

Each kind of candidate has a pattern. The kinds assign, access and hex stand alone and are always reported. Weak
candidates (bare access identifiers, 40-character keys, endpoints) are reported only if complementary parts co-occur:
an interval join pairs each candidate with the parts of the other roles within SCOPE code points of its start in the
same document. The join is a sort and a sweep: a window by document, ordered by position, with a range frame counts
the parts of each role, so no pairs are made, whatever stands in a document.

A text's matches become one row each. Their places follow from the text between them: a running sum of its lengths and
theirs. Only these rows are shuffled, by row of the input, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import any_names, plain

SCOPE = 400  # code points within which parts belong together
MARK = "[secret]"  # stands for what redact() takes out


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# How the three kinds that stand alone are written.
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = f"({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')}){VALUE}"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

_named = "|".join(_either_case(w) for w in ("access_key_id", "client_id", "key_id", "account", "login"))
KEY_ID = rf"""(?:ASIA|AROA|AIDA)[A-Z0-9]{{16,}}|(?:{_named})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{4,}}"""
KEY = "[A-Za-z0-9+/]{40,}"
ENDPOINT = rf"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?|(?:{_either_case("endpoint")}|{_either_case("host")})["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{{4,}}"""
#: In the order in which kinds at the same place are listed.
KINDS = ("assign", "access", "hex", "key_id", "key", "endpoint")
PATTERNS = (ASSIGN, ACCESS, HEX, KEY_ID, KEY, ENDPOINT)


def _has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def _quick(text: Column, low: Column) -> dict[str, Column]:
    """For each kind a test that all texts pass in which one of this kind is reported; low: the text in lower case. Only
    where an identifier may stand, keys and endpoints can be."""
    identifier = _has(text, "ASIA", "AROA", "AIDA") | _has(low, "key_id", "client_id", "account", "login")
    some = _has(text, "AKIA") | identifier
    return {
        "assign": _has(low, "password", "passwd", "secret", "token", "api"),
        "access": _has(text, "AKIA"),
        "hex": text.rlike(HEX),
        "key_id": identifier,
        "key": some & text.rlike(KEY),
        "endpoint": some & (_has(text, "http://", "https://") | _has(low, "endpoint", "host")),
    }


def _parts(text: Column, low: Column, kind: int) -> Column:
    """An array of a struct for each match of a kind: the lengths of what stands before it and of itself, and if it counts."""
    pattern, quick = PATTERNS[kind], _quick(text, low)[KINDS[kind]]
    between = F.split(text, pattern, -1)
    if KINDS[kind] == "assign":
        matches = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
        whole, fine = lambda x: x["m"], lambda x: F.length(x["v"]) >= 6
    else:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        whole, fine = lambda x: x, lambda x: F.lit(True)
        if KINDS[kind] == "key":
            fine = lambda x: (F.length(x) == 40) & x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]")

    def one(x: Column, i: Column, lead: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(lead, i)).cast("long").alias("lead"), F.length(whole(x)).cast("long").alias("size"), fine(x).alias("fine"))

    found = let(between, lambda lead: F.transform(matches, lambda x, i: one(x, i, lead)))  # split once for all matches
    return F.when(quick, found).otherwise(F.array().cast("array<struct<kind:int,i:int,lead:bigint,size:bigint,fine:boolean>>"))


def parts(docs: DataFrame, *kept: str) -> DataFrame:
    """A row for each reported span of each row of docs, and one with kind null for those without any.

    Columns: row (a number for each row of docs), doc_id, kind (as in KINDS), start, end, and those in kept, which are
    null in all but one of a row's.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    rows = rows.withColumn("low", F.lower("text"))
    found = rows.select("row", "doc_id", *kept, F.posexplode_outer(F.concat(*[_parts(F.col("text"), F.col("low"), k) for k in range(len(KINDS))])).alias("nth", "p"))
    found = found.select("row", "doc_id", *[F.when(F.coalesce("nth", F.lit(0)) == 0, F.col(k)).alias(k) for k in kept], "p.*")
    dealt = found.repartition(F.col("row"))
    placed = dealt.withColumn("end", F.sum(F.col("lead") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))).withColumn("start", F.col("end") - F.col("size"))
    first_weak = KINDS.index("key_id")
    placed = placed.withColumn("fine", F.coalesce("fine", F.lit(True)))
    strong = F.col("kind") < first_weak
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    within = F.max(F.when(F.col("fine") & strong, F.col("end"))).over(before)
    placed = placed.withColumn("fine", F.col("fine") & (strong | F.col("kind").isNull() | F.coalesce(within <= F.col("start"), F.lit(True))))
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    role = {"id": ("access", "key_id"), "secret": ("assign", "hex", "key"), "endpoint": ("endpoint",)}

    def beside(name: str) -> Column:
        is_one = F.col("fine") & F.col("kind").isin([KINDS.index(k) for k in role[name]])
        return F.coalesce(F.sum(F.when(is_one, 1)).over(near), F.lit(0)) > 0

    placed = placed.withColumns({name: beside(name) for name in ("id", "secret")})
    kind = F.col("kind")
    linked = F.when(kind == KINDS.index("key_id"), F.col("secret")).when(kind == KINDS.index("key"), F.col("id")).when(kind == KINDS.index("endpoint"), F.col("id") & F.col("secret")).otherwise(True)
    # a row of docs without a reported span must stay, so spans that aren't reported become rows without a kind
    good = F.col("fine") & linked
    return placed.select("row", "doc_id", *kept, *[F.when(good, F.col(c)).alias(c) for c in ("kind", "start", "end")])


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """For each row: the numbers of spans of the kinds that stand alone, a digest of these, and all spans, also as text.

    Null texts are empty; a row without spans has zeros and empty lists; repeated rows and null doc_ids stay; an empty
    table gives no rows; other columns are left out.
    """
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    grouped = parts(plain(docs)).groupBy("row").agg(F.first("doc_id").alias("doc_id"), spans.alias("found"))
    base = F.filter("found", lambda s: s["kind"] < KINDS.index("key_id"))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(i) for i, k in enumerate(KINDS[:3])}
    return grouped.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


@any_names
def redact(docs: DataFrame) -> DataFrame:
    """docs with each reported span, or run of overlapping ones, replaced by MARK; n_chars follows if it is a column.

    All other columns and all rows stay; a null text stays null.
    """
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("whole"), "doc_id", "text")
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "end"))))
    grouped = parts(whole, "whole").groupBy("row").agg(F.first("whole", ignorenulls=True).alias("whole"), spans.alias("found"))
    text = F.col("whole.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def take(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        out = F.when(fresh, F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(MARK))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    clean = F.aggregate("found", start, take, lambda done: F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), F.length(text))))
    changed = grouped.withColumn("clean", F.when(F.size("found") > 0, clean).otherwise(text))
    length = F.when(F.size("found") > 0, F.length("clean").cast("long"))
    out = []
    for n in names:
        old = F.col("whole").getField(n)
        if n == "text":
            old = F.col("clean")
        elif n == "n_chars":
            old = F.coalesce(length.cast(docs.schema[n].dataType), old)
        out.append(old.alias(n))
    return changed.select(*out)
