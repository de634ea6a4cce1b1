"""Secret scan with multipart credential linking, in DataFrame functions alone.

Matches of a pattern are found once a text; the lengths of what lies between them (split by the same pattern) give
their code-point positions by a running sum. Base kinds (assign, access, hex) are always reported. Weak kinds
are sought only in texts with an access identifier or an account, as none links without, and reported only when complementary parts lie in scope, that is,
with at most `scope` code points between the end of one and the start of the other: a bare secret (40 mixed characters) with an access identifier or account; an
account with a secret and an endpoint; an endpoint with a secret and an access identifier or account. The
interval join of parts is a running maximum of ends and a minimum of starts over positions in a text, which makes no pairs.

Defined cases: a null text is empty. Every input row gives one row, repeated rows and null ids too. A text without
spans has empty strings and the hash of the empty string. Only doc_id and text are read. One shuffle of narrow
rows (a row a match, one at least a text); no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
#: A host name has 127 labels at most; the bound also keeps the matcher's recursion shallow in very long dotted runs.
ENDPOINT = r"""(?:[a-z][a-z0-9+]{1,15}://[^\x00-\x20"'<>|]+|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+){0,126}\.(?:com|net|org|io|dev|cloud)(?::[0-9]+)?(?![A-Za-z0-9-])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.]))"""
ACCOUNT = r"""(?<![A-Za-z])(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "secret", "account", "endpoint")


def _parts(text: Column, kind: str, pattern: str, found: Column, group: int = 0, least: int = 1) -> Column:
    """An array of (kind, position in order, characters before since the last match, length, whether it counts)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.filter(F.arrays_zip(matches.alias("m"), inner.alias("g"), gaps.alias("gap")), lambda x: x["m"].isNotNull())
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("k"),
            x["gap"].alias("gap"),
            F.length(x["m"]).alias("len"),
            (F.length(x["g"]) >= least).alias("ok"),
        ),
    )
    return F.when(found, each).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,len:int,ok:boolean>>"))


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked for every document."""
    text = F.col("_text")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    multi = text.contains("AKIA") | text.rlike(ACCOUNT)
    parts = F.concat(
        _parts(text, "assign", ASSIGN, text.rlike(ASSIGN), 2, 6),
        _parts(text, "access", ACCESS, multi, 0, 20),
        _parts(text, "hex", HEX, text.rlike("[0-9a-f]{24}")),
        _parts(text, "secret", SECRET, multi),
        _parts(text, "account", ACCOUNT, multi),
        _parts(text, "endpoint", ENDPOINT, multi),
    )
    rows = rows.select("doc_id", parts.alias("_p")).select("doc_id", F.monotonically_increasing_id().alias("_u"), "_p")
    rows = rows.select("doc_id", "_u", F.inline_outer("_p")).repartition("_u")
    order = Window.partitionBy("_u", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_end", F.sum(F.col("gap").cast("long") + F.col("len")).over(order))
    placed = placed.where(F.col("ok") | F.col("kind").isNull() | (F.col("k") == 0))  # a text whose matches all fail keeps a row
    kind, start = F.when(F.col("ok"), F.col("kind")), F.col("_end") - F.col("len")
    placed = placed.select("doc_id", "_u", kind.alias("kind"), start.alias("start"), F.col("_end").alias("end"))
    before = Window.partitionBy("_u").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_u").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)  # a frame that only grows

    def some(*names):
        ours = F.col("kind").isin([KINDS.index(x) for x in names])
        left, right = F.max(F.when(ours, F.col("end"))).over(before), F.min(F.when(ours, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - left <= scope, F.lit(False)) | F.coalesce(right - F.col("end") <= scope, F.lit(False))

    placed = placed.select("*", some("access", "account").alias("_id"), some("assign", "hex", "secret").alias("_secret"), some("endpoint").alias("_at"), some("access").alias("_key"))
    linked = (
        (F.col("kind") <= 2)
        | ((F.col("kind") == 3) & F.col("_id"))
        | ((F.col("kind") == 4) & F.col("_secret") & F.col("_at"))
        | ((F.col("kind") == 5) & F.col("_secret") & F.col("_id"))
    )
    span = F.when(linked, F.struct("start", "kind", "end"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    found = placed.groupBy("_u", "doc_id").agg(
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.array_sort(F.collect_list(span)).alias("_s")
    )
    names = F.array(*[F.lit(x) for x in KINDS])
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("_s", lambda x: x["kind"] <= 2)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(join(base), 256).alias("base_sha256"), join(F.col("_s")).alias("spans"), (F.size("_s") - F.size(base)).cast("long").alias("n_linked"))
