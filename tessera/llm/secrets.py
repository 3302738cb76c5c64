"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found row by row: assignments, access keys, hex runs, and (the method's own kind)
``bare`` tokens of mixed upper case, lower case and digits. Their values' hashes are counted over the
whole corpus by distinct owners and repositories, pre-aggregated so that a value in a third of all
rows is no more than one row per task and owner. A value that ``COPIED_OWNERS`` or more owners hold is
a copied example; one that fewer hold is live if it looks random, else weak. Base spans always stay;
bare spans are added only where live.

Defined results: null text counts as empty; a null owner or repository counts as one owner or
repository of its own. Repeated rows get a row each. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, written

# fixed values: the patterns, their names in order of listing, and the shortest match of each
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BARE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "bare"]
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
PLACEHOLDER = r"(?i)example|sample|change_?me|placeholder|dummy|your|xxxx|1234567|abcdef|test|redacted"
#: Owners from which on a value counts as copied.
COPIED_OWNERS = 3
FOUND = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int, good) -> Column:
    """Spans of the matches of ``pattern``: lengths between and of the matches, added up from the left."""
    between, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), value.alias("v")), lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        stop = begin + m["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), m["v"].alias("value")))
        return F.struct(stop.alias("at"), F.when(good(m), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {FOUND})"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their values, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(
        _matches(text, ASSIGN, 0, 2, lambda m: F.length(m["v"]) >= ASSIGN_VALUE),
        _matches(text, ACCESS, 1, 0, lambda m: m["size"] >= ACCESS_LENGTH),
        _matches(text, HEX, 2, 0, lambda m: F.lit(True)),
    )
    bare = _matches(text, BARE, 3, 0, lambda m: m["v"].rlike("[A-Z]") & m["v"].rlike("[a-z]") & m["v"].rlike("[0-9]"))
    free = F.filter(bare, lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return F.array_sort(F.concat(base, free))


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 6) & ~value.rlike(PLACEHOLDER)


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Of each candidate value: hash, owners, repositories and standing (copied, live, weak).

    ``found``: owner, repository, found.
    """
    held = found.where(F.size("found") > 0).select(F.coalesce(F.col("owner").cast("string"), F.lit("\0")).alias("owner"), F.coalesce(F.col("repository").cast("string"), F.lit("\0")).alias("repository"), F.explode("found").alias("f"))
    by_repository = held.groupBy(F.sha2("f.value", 256).alias("hash"), "owner", "repository").agg(F.max(looks_live(F.col("f.value"))).alias("live"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("live").alias("live"))
    total = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("live").alias("live"))
    return total.select("hash", "owners", "repositories", F.when(F.col("owners") >= copied_owners, "copied").when(F.col("live"), "live").otherwise("weak").alias("standing"))


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row key with candidates: its spans (start, kind, stop, standing), bare ones only if live."""
    one = found.where(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.start", "f.kind", "f.stop", F.sha2("f.value", 256).alias("hash"))
    kept = one.join(ownership(found, copied_owners), "hash").where("kind < 3 or standing = 'live'")
    return kept.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "stop", "standing"))).alias("spans"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """doc_id, key, owner, repository, and the candidates found; written once, without the texts."""
    repo = F.col(repository or doc_id)
    return written(docs.select(F.col(doc_id).alias("doc_id"), _row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(owner).alias("owner"), repo.alias("repository"), candidates(F.col(text)).alias("found")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def secret_spans(docs: DataFrame, *, copied_owners: int = COPIED_OWNERS, **columns) -> DataFrame:
    """doc_id, base counts and digest, and all spans with how many are live and copied."""
    found = scan(docs, **columns)
    base = F.filter("found", lambda f: f["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("bigint")
    rows = found.select("doc_id", "key", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"))
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,standing:string>>)"))
    standing = lambda s: F.size(F.filter(spans, lambda x: x["standing"] == s)).cast("bigint")
    return rows.join(judged(found, copied_owners), "key", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(spans).alias("spans"), standing("live").alias("n_live"), standing("copied").alias("n_copied"))


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, copied_owners: int = COPIED_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """The documents with live spans replaced by ``mark``; only texts that have one are moved."""
    found = scan(docs, doc_id=doc_id, text=text, owner=owner, repository=repository)
    live = judged(found, copied_owners).select(F.col("key").alias("__key"), F.filter("spans", lambda s: s["standing"] == "live").alias("__live")).where(F.size("__live") > 0)
    keyed = docs.withColumn("__key", _row_key(F.col(doc_id), F.col(text)))
    suspect = F.coalesce(F.col(text).rlike(ASSIGN) | F.col(text).rlike(ACCESS) | F.col(text).rlike(HEX) | F.col(text).rlike(BARE), F.lit(False))
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # spans may overlap: each adds the text up to it, and a mark only where it begins a new stretch
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate("__live", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    changed = keyed.where(suspect).join(live, "__key", "left").withColumn(text, F.when(F.col("__live").isNotNull(), done).otherwise(t))
    return keyed.where(~suspect).select(*docs.columns).union(changed.select(*docs.columns))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    bare = r"[A-Za-z0-9_-]{20,}"  # leftmost maximal runs: the lookbehind only saves time
    one = lambda kind, pattern, group, good: f"""
 select doc_id, source, {kind} kind, i, b, w, v from (select doc_id, source, unnest(range(1, len(w) + 1)) i, b, w, v from
  (select doc_id, source, string_split_regex(t, {q(pattern)}) b, regexp_extract_all(t, {q(pattern)}, 0) w, regexp_extract_all(t, {q(pattern)}, {group}) v from d where regexp_matches(t, {q(pattern)}))) where {good}"""  # noqa: E731
    return f"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
m as ({one(0, ASSIGN, 2, "len(v[i]) >= 6")} union all {one(1, ACCESS, 0, "len(w[i]) >= 20")} union all {one(2, HEX, 0, "true")}
 union all {one(3, bare, 0, "regexp_matches(v[i], '[A-Z]') and regexp_matches(v[i], '[a-z]') and regexp_matches(v[i], '[0-9]')")}),
p as (select doc_id, source, kind, v[i] v, coalesce(list_sum(list_transform(b[1:i], lambda x: len(x))), 0)::bigint + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0)::bigint s, len(w[i]) n from m),
c as (select * from p where kind < 3 or not exists (select 1 from p b where b.doc_id = p.doc_id and b.kind < 3 and b.s < p.s + p.n and p.s < b.s + b.n)),
o as (select v, count(distinct coalesce(source, chr(0))) owners from c group by v),
k as (select c.*, case when owners >= {COPIED_OWNERS} then 'copied' when len(c.v) >= 8 and regexp_matches(c.v, '[0-9]') and regexp_matches(c.v, '[A-Za-z]') and len(list_distinct(string_split(c.v, ''))) >= 6
  and not regexp_matches(c.v, {q(PLACEHOLDER)}) then 'live' else 'weak' end standing from c join o on c.v = o.v),
a as (select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
  string_agg(['assign','access','hex'][kind + 1] || ':' || s || ':' || (s + n), ',' order by s, kind) filter (kind < 3) base,
  string_agg(['assign','access','hex','bare'][kind + 1] || ':' || s || ':' || (s + n), ',' order by s, kind) filter (kind < 3 or standing = 'live') spans,
  count(*) filter (standing = 'live') n_live, count(*) filter (standing = 'copied' and kind < 3) n_copied from k group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
 coalesce(n_live, 0)::bigint n_live, coalesce(n_copied, 0)::bigint n_copied from d left join a using (doc_id)"""


ORACLE = {"op8_secrets": _oracle()}
QUERIES = {"op8_secrets": op8_secrets}
