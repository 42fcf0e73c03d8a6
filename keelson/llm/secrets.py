"""Secret scan: spans by pattern, then the ownership frequency of what they hold over the whole corpus.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joined_by


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns, in the order of their kinds (fixed values), and the least length of what must be long.
ASSIGN = "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
#: Further candidates: long runs that mix letters and digits and repeat few characters.
CANDIDATE = "[A-Za-z0-9_+=-]{20,}"
LIVE = "live"
#: A text without a match of this has no span of any kind.
ANY = f"{ASSIGN}|AKIA[A-Z0-9]|[0-9a-f]{{32}}|{CANDIDATE}"
SPAN = "struct<start:int,kind:int,end:int,hash:string>"
MARK = "[SECRET]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state (of the SQL type ``kind``) before each item of an array, folded from ``zero`` by ``step``.

    Growing an array copies it, so the items are folded in blocks of about the root of their number: first the state
    before each block, then the states within each. Copies stay at n * sqrt(n) for n items of one text.
    """
    none = F.array().cast(f"array<{kind}>")
    more = lambda acc, state: F.struct(state.alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))

    def fold(items: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), width), lambda at: F.slice(items, at + 1, width))
        return let(blocks, states)

    def states(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.struct(zero.alias("state"), none.alias("out")), lambda acc, block: more(acc, F.aggregate(block, acc["state"], step)), lambda acc: acc["out"])
        within = lambda block, state: F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), lambda acc, x: more(acc, step(acc["state"], x)), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begins, within))

    return let(items, fold)


def matches(text: Column, pattern: str, kind: int, group: int, least: int, more: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with their places in code points; those that are too short fall out.

    Places come from the lengths of what lies between, added up. ``more`` names a further test of a match's ``found``.
    """
    gaps = F.transform(F.split(text, F.lit(pattern), -1), F.length)
    found = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, x: F.struct(gap.alias("gap"), F.length(x).alias("n"), x.alias("found")))
    value = lambda x: F.regexp_extract(x["found"], pattern, group) if group else x["found"]
    fits = lambda x: F.length(value(x)) >= least

    def placed(found: Column) -> Column:
        before = running(found, F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(x["n"], F.lit(0)), "int")
        return F.zip_with(before, found, lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["found"].alias("found")))

    held = F.filter(let(found, placed), lambda x: x["found"].isNotNull() & fits(x) & (F.lit(True) if more is None else more(x["found"])))
    return F.transform(held, lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(value(x), 256).alias("hash")))


def mixed(found: Column) -> Column:
    """Letters, digits and many distinct characters, as made-up values have them."""
    return (F.length(F.regexp_replace(found, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(found, "[^A-Za-z]", "")) >= 4) & (F.size(F.array_distinct(F.split(found, ""))) >= 10)


def beside(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``: both in one order, against the ends before and the starts after."""

    def judged(both: Column) -> Column:
        sure = lambda x: x["kind"] < len(BASE)
        ends = running(both, F.lit(0), lambda end, x: F.when(sure(x), F.greatest(end, x["end"])).otherwise(end), "int")
        starts = F.reverse(running(F.reverse(both), F.lit(2**31 - 1), lambda start, x: F.when(sure(x), F.least(start, x["start"])).otherwise(start), "int"))
        around = F.zip_with(F.zip_with(both, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end"))), starts, lambda y, start: F.struct(y["x"].alias("x"), y["end"].alias("end"), start.alias("start")))
        return F.transform(F.filter(around, lambda y: ~sure(y["x"]) & (y["end"] <= y["x"]["start"]) & (y["start"] >= y["x"]["end"])), lambda y: y["x"])

    return F.when(F.size(more) > 0, let(F.array_sort(F.concat(base, more)), judged)).otherwise(more)


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__base`` and ``__more``: spans of the base patterns, by start, and further candidates beside them."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.array_sort(F.concat(*[matches(text, pattern, k, group, least) for k, (_, pattern, group, least) in enumerate(BASE)]))
    some = docs.withColumn("__some", text.rlike(ANY))
    both = some.withColumns({"__base": F.when(F.col("__some"), base).otherwise(none).cast(f"array<{SPAN}>"), "__long": F.when(F.col("__some"), matches(text, CANDIDATE, len(BASE), 0, 20, mixed)).otherwise(none).cast(f"array<{SPAN}>")})
    return both.withColumn("__more", beside(F.col("__base"), F.col("__long")).cast(f"array<{SPAN}>")).drop("__some", "__long")


def without(text: Column, spans: Column, chunk: int = 1024) -> Column:
    """``text`` with each stretch of ``spans`` (by start) replaced by the mark; spans that overlap are one stretch.

    A place in a string is found by counting from its begin, so the text is cut into chunks once and each piece between
    two stretches is taken from its own few chunks.
    """

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / chunk).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / chunk).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(near, a - first * chunk + 1, b - a)).otherwise(F.lit(""))

    def cut(chunks: Column) -> Column:
        ends = running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), "int")
        gaps = F.filter(F.zip_with(spans, ends, lambda x, at: F.struct(at.alias("a"), x["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        last = F.array(F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("a"), F.length(text).alias("b")))
        return F.array_join(F.transform(F.concat(gaps, last), lambda g: piece(chunks, g["a"], g["b"])), MARK)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), cut)).otherwise(text)


def ownership(evidence: DataFrame) -> DataFrame:
    """(hash, n_rows, n_repositories, n_owners) from (hash, repository, owner): three aggregations with partial sums.

    Distinct pairs are folded where they are read, so a hash that a third of all rows hold costs a row per owner.
    """
    by_pair = evidence.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_pair.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def live_hashes(found: DataFrame, max_owners: int, max_repositories: int, asked: Column | None = None) -> DataFrame:
    """(id, text_hash, live): the hashes of each text that few owners and repositories hold.

    Owners and repositories are counted over all rows; the result has only the rows that are ``asked`` for. A hash that
    a single owner's many rows hold is broadcast to them, all others are joined by shuffle.
    """
    held = lambda rows: rows.select("id", "text_hash", "owner", "repository", F.explode(F.transform(F.concat("base", "more"), lambda x: x["hash"])).alias("hash"))
    rare = durable(ownership(held(found)).where((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).select("hash", "n_rows"))
    total = rare.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    rows = held(found if asked is None else found.where(asked)).select("id", "text_hash", "hash").distinct()
    return joined_by(rows, rare, "hash", "n_rows", total).groupBy("id", "text_hash").agg(F.collect_set("hash").alias("live"))  # within one text


def findings(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(id, text_hash, owner, repository, base, more) of every row, without the texts, in the shared folder."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), owner.alias("owner"), repository.alias("repository"))
    return durable(scanned(source, "text").select("id", F.xxhash64("text").alias("text_hash"), "owner", "repository", F.col("__base").alias("base"), F.col("__more").alias("more")))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(LIVE))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def owner_columns(owner_col: str, repository_cols: list[str]) -> tuple[Column, Column]:
    return F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")), F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repository_cols])


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """Spans of secrets in every whole text, and which of them look live.

    Returns (id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied). What a span holds is hashed, and each
    hash's distinct owners and repositories are counted over the whole corpus. A hash of at most ``max_owners`` owners
    and ``max_repositories`` repositories looks live, any other is a widely copied example. Base spans always stay;
    further candidates become spans of the kind ``live`` only if they look live. ``n_live`` and ``n_copied`` count base
    spans and candidates by that.

    Null and empty texts have no span. Null owners and repositories count as the empty name. Repeated rows give repeated
    results and count as one owner. A null id is kept. An empty table gives an empty result.
    """
    found = findings(docs, id_col, text_col, *owner_columns(owner_col, list(repository_cols)))
    live = live_hashes(found, max_owners, max_repositories).withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    joined = found.join(live, found["id"].eqNullSafe(F.col("__id")) & (found["text_hash"] == F.col("__hash")), "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    has = lambda x: F.array_contains(F.col("live"), x["hash"])
    spans = F.array_sort(F.concat("base", F.filter("more", has)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    lively = F.size(F.filter(F.concat("base", "more"), has)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"),
        lively.alias("n_live"), (F.size(F.concat("base", "more")) - lively).alias("n_copied"),
    )


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """``docs`` with every span that ``secrets`` reports replaced by ``[SECRET]``; all rows and columns stay.

    Texts are scanned once; the rows with their spans are kept in the shared folder. Hashes are counted over all of
    them, as ``secrets`` counts them; only texts with further candidates are joined with the counts, the others are
    settled where they are read. Null and empty texts have no span and stay as they are; null owners and repositories
    count as the empty name; a null id is kept; repeated rows are all kept; an empty table stays empty.
    """
    owner, repository = owner_columns(owner_col, list(repository_cols))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), owner.alias("owner"), repository.alias("repository"))
    held = durable(scanned(source, "text").select("row", "id", F.xxhash64("text").alias("text_hash"), "owner", "repository", F.col("__base").alias("base"), F.col("__more").alias("more")))
    live = live_hashes(held, max_owners, max_repositories, F.size("more") > 0).withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    plain = held.where(F.size("more") == 0).select("row", F.col("base").alias("spans"))
    rest = held.where(F.size("more") > 0).join(live, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    rest = rest.select("row", F.array_sort(F.concat("base", F.filter("more", lambda x: F.coalesce(F.array_contains(F.col("live"), x["hash"]), F.lit(False))))).alias("spans"))
    text = F.col("row")[text_col]
    return plain.unionByName(rest).select(*[(without(text, F.col("spans")) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [*BASE, (LIVE, CANDIDATE, 0, 20)]
    parts = " UNION ALL ".join(f"SELECT rid, {k} AS kind, {g} AS grp, {least} AS least, string_split_regex(t, {quote(p)}) AS gaps, regexp_extract_all(t, {quote(p)}) AS found, regexp_extract_all(t, {quote(p)}, {g}) AS held FROM d" for k, (_, p, g, least) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k}'" for k, *_ in kinds) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
m AS ({parts}),
u AS (SELECT rid, kind, least, gaps, found, held, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT rid, kind, held[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[i]) AS n FROM u WHERE length(held[i]) >= least),
c AS (SELECT * FROM s WHERE kind < {len(BASE)} OR (length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 AND len(list_distinct(string_split(v, ''))) >= 10
  AND NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.kind < {len(BASE)} AND s.a < b.a + b.n AND b.a < s.a + s.n))),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM c JOIN d USING (rid) GROUP BY v),
x AS (SELECT c.*, owners <= 1 AND repositories <= 2 AS live FROM c JOIN o USING (v)),
j AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({names}[kind + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({names}[kind + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) FILTER (kind < {len(BASE)} OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM x GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN j USING (rid)
"""


SECRETS_SQL = _sql()
