"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak parts (an identifier, a short or bare secret, an endpoint) are
reported only when a complementary part lies within a scope of the same document. Secrets are joined as intervals, wider
by the scope on either side, with identifiers and endpoints: both are dealt to stretches of ``STRETCH`` characters and
meet there, each pair in the first stretch that both have. Parts of one pattern don't overlap, so a part has few links
however many parts a document has, and a very long part as many as lie beside or in it.

All DataFrame functions. Positions come from the lengths of the matches and of the gaps between them, added up by a
window. Null texts count as empty; empty texts have no spans. A very long text is read whole. Repeated rows are worked
out once and each returned. Ties (parts at one position) are ordered by kind. An empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.llm.common import stored

#: Patterns of the query contract (fixed values). Matches of "assign" with fewer than 8 characters in group 2 are dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With so many characters at least, these are whole runs, as with "+" and a filter by length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts.
IDENTIFIER = r"""(?i)\b(client_?id|access_?key_?id|account(?:_?id)?|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
BARE_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?i)\b(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@-]+|(?:endpoint|host|hostname|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,})"""
#: Kinds in the order of reports: strong ones first.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
LEAST_ASSIGN = 8
#: Complementary parts are linked over at most so many characters.
SCOPE = 200
#: Characters of a stretch that intervals are dealt to.
STRETCH = 1024


def _parts(text: Column, pattern: str, kind: str, when: Column, keep=None) -> Column:
    """Array of struct(kind, nth, gap, length, what) for every match in order; what: 0 dropped, else the kind's number from 1.

    gap: characters between the previous match and this one.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def part(x: Column, i: Column) -> Column:
        what = F.lit(KINDS.index(kind) + 1) if keep is None else keep(x["hit"])
        return F.struct(F.lit(kind).alias("pattern"), i.alias("nth"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("length"), what.alias("what"))

    found = F.filter(F.transform(pieces, part), lambda p: p["length"].isNotNull())
    return F.when(when, found).otherwise(found_none())


def found_none() -> Column:
    return F.array().cast("array<struct<pattern:string,nth:int,gap:int,length:int,what:int>>")


def credential_parts(docs: DataFrame) -> DataFrame:
    """Per document and distinct text: its parts (_parts) and the number of copies of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = lambda hit: F.when(F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_ASSIGN, F.lit(1)).otherwise(F.lit(5))  # noqa: E731  too short: a weak secret
    mixed = lambda hit: F.when(hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]"), F.lit(5)).otherwise(F.lit(0))
    secret = F.concat(
        _parts(text, ASSIGN, "assign", text.rlike(r"(?i)password|passwd|secret|token|api_?key"), assigned),
        _parts(text, ACCESS, "access", text.contains("AKIA")),
        _parts(text, HEX, "hex", text.rlike("[0-9a-f]{32}")),
        _parts(text, BARE_SECRET, "secret", text.rlike("[A-Za-z0-9+/]{40}"), mixed),
    )
    with_secret = docs.select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("_key"), secret.alias("_secret"))
    any_secret = F.size("_secret") > 0
    rest = F.concat(_parts(text, IDENTIFIER, "identifier", any_secret), _parts(text, ENDPOINT, "endpoint", any_secret))
    return with_secret.select("doc_id", "_key", F.concat("_secret", rest).alias("_parts")).groupBy("doc_id", "_key", "_parts").agg(F.count(F.lit(1)).alias("_copies"))


def _placed(docs: DataFrame) -> DataFrame:
    """A row for each part: doc_id, _key, _copies, start, end and its kind's number ``what`` (null, for a text without parts)."""
    rows = credential_parts(docs).select("doc_id", "_key", "_copies", F.explode_outer("_parts").alias("p")).select("doc_id", "_key", "_copies", "p.*")
    so_far = Window.partitionBy("doc_id", "_key", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return rows.repartition("doc_id", "_key").select("doc_id", "_key", "_copies", (end - F.col("length")).alias("start"), end.alias("end"), "what")


def links(placed: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Pairs of parts in scope of each other, both ways round: doc_id, _key, start, end, what and the other part ``to``
    (gap, start, end, what); a gap below 0 means that they overlap."""
    stretches = lambda low, high: F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH))
    low, high = F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope
    secrets = placed.filter(F.col("what").isin(1, 3, 5)).withColumns({"first": F.floor(low / STRETCH), "at": F.explode(stretches(low, high))}).alias("s")
    others = placed.filter(F.col("what").isin(2, 4, 6)).withColumns({"first": F.floor(F.col("start") / STRETCH), "at": F.explode(stretches(F.col("start"), F.col("end")))}).alias("o")
    same = F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s._key") == F.col("o._key")) & (F.col("s.at") == F.col("o.at"))
    once = F.col("s.at") == F.greatest("s.first", "o.first")
    gap = F.greatest(F.col("o.start") - F.col("s.end"), F.col("s.start") - F.col("o.end"))
    met = secrets.join(others, same & once & (gap <= scope)).withColumn("gap", gap)

    def seen(x: str, y: str) -> DataFrame:
        return met.select(*(F.col(f"{x}.{c}") for c in ("doc_id", "_key", "start", "end", "what")), F.struct("gap", *(F.col(f"{y}.{c}") for c in ("start", "end", "what"))).alias("to"))

    return seen("s", "o").union(seen("o", "s"))


def linked_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document and distinct text: doc_id, _key, _copies and ``spans``, sorted by start, then kind.

    A span is struct(start, rank, kind, end, linked): code points, end exclusive; ``linked`` has the start and kind of each
    complementary part in scope, the nearest first (none, as strong spans may have).
    """
    placed, own = stored(_placed(docs), "parts"), ["doc_id", "_key", "start", "end", "what"]
    name = lambda what: F.element_at(F.array(*map(F.lit, KINDS)), F.when(what > 0, what))
    both = placed.select(*own, "_copies", F.lit(None).cast("struct<gap:bigint,start:bigint,end:bigint,what:int>").alias("to")).unionByName(links(placed, scope).withColumn("_copies", F.lit(None).cast("long")))
    parts = both.groupBy(*own).agg(F.max("_copies").alias("_copies"), F.array_sort(F.collect_set("to")).alias("to"))
    linked = F.transform("to", lambda t: F.struct(t["start"].alias("start"), name(t["what"]).alias("kind")))
    kind = F.col("what")
    span = F.struct("start", (kind - 1).alias("rank"), name(kind).alias("kind"), "end", linked.alias("linked"))
    kept = parts.withColumn("span", F.when((kind > 0) & ((kind <= 3) | (F.size("to") > 0)), span))
    return kept.groupBy("doc_id", "_key").agg(F.max("_copies").alias("_copies"), F.sort_array(F.collect_list("span")).alias("spans"))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``links``: each secret's start, and the kinds and starts of what is linked to it."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    to = lambda s: F.array_join(F.transform(F.array_sort(s["linked"]), lambda x: F.concat_ws(":", x["kind"], x["start"])), "+")
    groups = F.filter("spans", lambda s: s["rank"].isin(0, 2, 4) & (F.size(s["linked"]) > 0))
    linked = F.array_join(F.transform(groups, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit("="), to(s))), ",")
    found = linked_spans(docs).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), linked.alias("links"))
