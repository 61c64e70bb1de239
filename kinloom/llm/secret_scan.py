"""Secret scan with corpus-wide ownership frequency (operator 2), in DataFrame functions only.

Candidates are the base kinds (assign, access, hex) and, as kind `vendor`, tokens in public
vendor formats. The hash of each candidate's value is counted over the corpus by distinct
owners and repositories. A value that COPIED_OWNERS owners hold is a copied example, and so is
one in COPIED_REPOSITORIES repositories, whoever owns them: an owner's credential is used in
some of its repositories, a template stands in hundreds. A value that few hold and that looks
random is live. Base spans are always reported; vendor spans are reported if they are live.

Positions come from the pieces between matches: the pattern splits the text, and the running
sum of the lengths of pieces and matches gives each match's start, in code points. Matches
are rows, not arrays that grow, so the work is in proportion to them, however many one text has.

Counting goes by (hash, owner, repository), then (hash, owner), then hash, each with partial
sums before the shuffle, so that a value in a third of all rows is no hot key.

Defined cases: null counts as empty; a text without candidates has empty spans; repeated rows
each get a row and count as one repository; a null owner or repository is one like others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, pick, position, read

#: A value that so many owners hold is an example that was copied.
COPIED_OWNERS = 3
#: So is one that stands in so many repositories, be they all of one owner.
COPIED_REPOSITORIES = 100
#: A live value has so many different characters at least, and none of these words.
LIVE_CHARACTERS = 6
PLACEHOLDERS = "(?i)example|sample|dummy|placeholder|changeme|your[-_]|xxxx|1234567"

#: Kind: pattern, group that holds the value, least length of the value.
KINDS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "vendor": (
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        0,
        16,
    ),
}
BASE = ("assign", "access", "hex")


def _pairs(text, matches, kind: str):
    """(gap, bytes, match) of the matches of one kind; gap and bytes measure the text since the match before."""
    gaps = F.slice(F.transform(F.split(text, KINDS[kind][0], -1), lambda x: F.struct(F.length(x).alias("gap"), F.octet_length(x).alias("bytes"))), F.lit(1), F.size(matches))
    found = F.zip_with(gaps, matches, lambda g, m: F.struct(g["gap"].alias("gap"), g["bytes"].alias("bytes"), m.alias("match")))
    return F.when(F.size(matches) > 0, found).otherwise(F.expr("cast(array() as array<struct<gap:int,bytes:int,match:string>>)"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(row, id, owner, repo, print, assign, access, hex, vendor): a row for every document, cut, without its text."""
    base = pick(docs, id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    base = base.withColumn("text", F.coalesce("text", F.lit("")))
    found = base.select("*", *[F.regexp_extract_all("text", F.lit(KINDS[k][0]), F.lit(0)).alias(f"m_{k}") for k in KINDS])
    pairs = [_pairs(F.col("text"), F.col(f"m_{k}"), k).alias(k) for k in KINDS]
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", F.xxhash64("text", F.length("text")).alias("print"), *pairs))


def candidates(found: DataFrame) -> DataFrame:
    """(row, owner, repo, start, rank, end, kind, hash, live, bytes_from, bytes_to) of every candidate, cut."""
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("pairs")) for i, k in enumerate(KINDS)])
    held = found.where(" or ".join(f"size({k}) > 0" for k in KINDS)).select("row", "owner", "repo", F.explode(kinds).alias("of"))
    each = held.select("row", "owner", "repo", "of.rank", "of.kind", F.posexplode("of.pairs").alias("i", "pair"))
    each = each.select("row", "owner", "repo", "rank", "kind", "i", "pair.*")
    so_far = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far).cast("int")
    bytes_to = F.sum(F.col("bytes") + F.octet_length("match")).over(so_far).cast("int")
    value, least = F.col("match"), F.lit(0)
    for kind, (pattern, group, length) in KINDS.items():
        if group:
            value = F.when(F.col("kind") == kind, F.regexp_extract("match", pattern, group)).otherwise(value)
        least = F.when(F.col("kind") == kind, length).otherwise(least)
    each = each.withColumn("end", end).withColumn("bytes_to", bytes_to).withColumn("value", value).where(F.length("value") >= least)
    varied = F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS
    live = varied & ~F.col("value").rlike(PLACEHOLDERS)
    start, bytes_from = F.col("end") - F.length("match"), F.col("bytes_to") - F.octet_length("match")
    return cut(each.select("row", "owner", "repo", start.alias("start"), "rank", "end", "kind", F.sha2("value", 256).alias("hash"), live.alias("live"), bytes_from.alias("bytes_from"), "bytes_to"))


def ownership(held: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value, from rows with hash, owner, repo."""
    once = held.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES
) -> DataFrame:
    """(id, print, spans) for every row of docs; a span has start, end, kind, hash, live, copied, owners, repositories,
    bytes_from and bytes_to (its place in the text's UTF-8).

    `print` is a checksum of the text."""
    found = matches(docs, id_col, text_col, owner_col, repo_col)
    each = candidates(found)
    told = join_counted(each, cut(ownership(each)), "hash", "inner")
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    fields = ("start", "rank", "end", "kind", "hash", "live", "copied", "owners", "repositories", "bytes_from", "bytes_to")
    told = told.withColumn("live", F.col("live") & ~copied).withColumn("copied", copied).select("row", *fields).where(F.col("kind").isin(*BASE) | F.col("live"))
    whole = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"))
    none = F.array().cast(whole.schema["spans"].dataType)
    return found.select("row", "id", "print").join(whole, "row", "left").select("id", "print", F.coalesce("spans", none).alias("spans"))


def listed(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every reported span replaced by a mark (overlapping spans by one), and length_col set anew where text changed."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, at = f"c{position(docs, id_col)}", f"c{position(docs, text_col)}"
    found = scan(docs, id_col, text_col, owner_col).where(F.size("spans") > 0)
    each = found.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), "print", "spans").dropDuplicates(["k", "print"]).select("k", "print", F.explode("spans").alias("s"))
    # Spans that overlap become one: a new one starts where all before have ended.
    by_text = Window.partitionBy("k", "print").orderBy("s.bytes_from", "s.rank")
    before = F.max("s.bytes_to").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("fresh", F.when(F.col("s.bytes_from") >= F.coalesce(before, F.lit(0)), 1).otherwise(0)).withColumn("n", F.sum("fresh").over(by_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy("k", "print", "n").agg(F.min("s.bytes_from").alias("from"), F.max("s.bytes_to").alias("to"))
    cuts = cut(joined.groupBy("k", "print").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("cuts")))
    text = F.coalesce(F.col(at), F.lit(""))
    keyed = plain.withColumn("k", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("print", F.xxhash64(text, F.length(text))).withColumn("raw", F.col(at).cast("binary"))
    few = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    both = join_counted(keyed, cuts, ["k", "print"], limit=200_000 if few <= 1_000_000 else 0)
    piece = "cast(substr(raw, if(i = 0, 0, cuts[i - 1].to) + 1, if(i = size(cuts), octet_length(raw), cuts[i].from) - if(i = 0, 0, cuts[i - 1].to)) as string)"
    new = F.array_join(F.expr(f"transform(sequence(0, size(cuts)), i -> {piece})"), mark)
    out = both.withColumn("new", F.when(F.col("cuts").isNotNull(), new))
    cols = []
    for i, f in enumerate(plain.schema):
        if f.name == at:
            cols.append(F.coalesce("new", at).alias(at))
        elif length_col and length_col in names and i == position(docs, length_col):
            cols.append(F.when(F.col("new").isNotNull(), F.length("new").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return out.select(*cols).toDF(*names)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
    )


def _one_kind(rank: int, kind: str) -> str:
    """SQL for the spans of one kind: places by running sums over the pieces between matches."""
    pattern, group, least = KINDS[kind]
    if kind == "assign":  # letters in either case, spelled out: (?i) there also folds letters beyond ASCII
        head, bracket, tail = pattern.removeprefix("(?i)").partition(")")
        pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + bracket + tail
    pattern = pattern.replace("'", "''")
    return f"""
SELECT r, owner, repo, {rank} AS rank, '{kind}' AS kind, (sum(length(gap)) OVER w + sum(length(match)) OVER w - length(match))::BIGINT AS a, (sum(length(gap)) OVER w + sum(length(match)) OVER w)::BIGINT AS z,
  regexp_extract(match, '{pattern}', {group}) AS v, length(v) >= {least} AS long
FROM (SELECT r, source AS owner, doc_id AS repo, unnest(m) AS match, unnest(regexp_split_to_array(text, '{pattern}')[:len(m)]) AS gap, unnest(range(len(m))) AS i
  FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS m FROM d) WHERE len(m) > 0)
WINDOW w AS (PARTITION BY r ORDER BY i)"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS (SELECT * FROM ({" UNION ALL ".join(f"({_one_kind(i, k)})" for i, k in enumerate(KINDS))}) WHERE long),
held AS (SELECT v, owner, count(*) AS repos FROM (SELECT DISTINCT v, owner, repo FROM found) GROUP BY v, owner),
copied AS (SELECT v FROM held GROUP BY v HAVING count(*) >= {COPIED_OWNERS} OR sum(repos) >= {COPIED_REPOSITORIES}),
told AS (SELECT f.*, c.v IS NOT NULL AS copied, len(list_distinct(string_split(f.v, ''))) >= {LIVE_CHARACTERS} AND NOT regexp_matches(f.v, '{PLACEHOLDERS}') AND c.v IS NULL AS live FROM found f LEFT JOIN copied c ON f.v = c.v),
s AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (kind <> 'vendor') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM told WHERE kind <> 'vendor' OR live GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN s USING (r)
"""
