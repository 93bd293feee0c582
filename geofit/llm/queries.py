"""The operators and the pipeline as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofit.llm import chat_format, decontam, jaccard_join, langid, merkle_manifest, packing, prefix_trie, sharding, sphere_caps, suffix_dedup, toxicity, url_filter, warc_fixity
from geofit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as a capture of a day of 2024, against dated lists made from the pages' own hosts and sections.

    The tables have no fetch day and no lists, so both come from the pages: the day from the id, and for each domain
    and section a history of additions and removals from its md5.
    """
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("fetched"))
    seen = pages.select(F.explode(url_filter.patterns_of(F.col("url"))).alias("pattern")).distinct()
    code = lambda at: F.conv(F.substring(F.md5("pattern"), at, 4), 16, 10).cast("int")
    history = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(bool(k % 2 == 0)).alias("added")) for k in range(4)]))
    day = F.date_add(F.to_date(F.lit("2023-10-01")), (code(5) % 200 + F.col("k") * (code(9) % 60)).cast("int"))
    entries = (
        seen.where(code(1) % 10 < 4).select("pattern", code(5).alias("c5"), history.alias("h")).select("pattern", "h.k", "h.added")
        .select(F.when(code(13) % 2 == 0, "malware").otherwise("spam").alias("list"), "pattern", day.alias("day"), "added")
    )
    judged = url_filter.apply_lists(captures, entries)
    return judged.select("page_id", F.col("fetched").cast("string").alias("fetched"), F.size("active").cast("long").alias("n_active"), (F.size("active") > 0).alias("blocked"), F.array_join("active", " ").alias("active"))


SQL["op1_url_lists"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
l AS (SELECT *, string_split(host, '.') AS lab FROM p WHERE host <> ''),
k AS (
  SELECT page_id, fetched, array_to_string(lab[len(lab) - n + 1 : len(lab)], '.') AS pattern FROM l, range(2, 9) t(n) WHERE n <= len(lab)
  UNION
  SELECT page_id, fetched, host || '/' || array_to_string(seg[1:n], '/') FROM l, range(1, 5) t(n) WHERE n <= len(seg)),
c AS (SELECT DISTINCT pattern, md5(pattern) AS h FROM k),
d AS (SELECT pattern, ('0x' || h[1:4])::INT AS c1, ('0x' || h[5:8])::INT AS c5, ('0x' || h[9:12])::INT AS c9, ('0x' || h[13:16])::INT AS c13 FROM c),
e AS (SELECT CASE WHEN c13 % 2 = 0 THEN 'malware' ELSE 'spam' END AS list, pattern, DATE '2023-10-01' + CAST(c5 % 200 + k * (c9 % 60) AS INTEGER) AS day, k % 2 = 0 AS added
  FROM d, range(4) t(k) WHERE c1 % 10 < 4),
a AS (SELECT list, pattern, day, min(added) AS added FROM e GROUP BY ALL),
latest AS (
  SELECT k.page_id, a.list, a.pattern, arg_max(a.added, a.day) AS added
  FROM k JOIN a ON a.pattern = k.pattern AND a.day <= k.fetched GROUP BY ALL),
act AS (SELECT page_id, count(*) AS n, string_agg(list || ':' || pattern, ' ' ORDER BY list || ':' || pattern) AS s FROM latest WHERE added GROUP BY page_id)
SELECT p.page_id, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(n, 0) AS n_active, coalesce(n, 0) > 0 AS blocked, coalesce(s, '') AS active
FROM p LEFT JOIN act USING (page_id)
"""


@query
def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.read_chats(chat_format.format_chats(turns.unionByName(added))))


SQL["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
    length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|TURN\]|/ROLE\]|ROLE |/?s>|</?SYS>>)', '\1\2\\\3', 'g')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *, size
    + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 7 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 3 ELSE 7 + 2 * strlen(role) END
    + CASE WHEN NOT closes THEN 0 WHEN role = 'system' THEN 8 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 7 END AS chars
  FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("spans")


@query
def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_caps.link(table(spark, sf_dir, "embeddings"))


SQL["op6_spherical_caps"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def _replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages as WARC files of up to 1,000 records: the second has one record in 256 with a byte
    changed and lacks one in 1,024, both chosen by the md5 of the id."""
    content = warc_fixity.record_text(F.col("url"), F.col("html"))
    file = F.concat(F.lit("part-"), F.coalesce((F.floor(F.col("page_id") / 1000)).cast("string"), F.lit("none")), F.lit(".warc"))
    before = Window.partitionBy("file").orderBy("page_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select("page_id", "url", "html", file.alias("file"), F.monotonically_increasing_id().alias("row"))
    sizes = rows.select("file", "page_id", "row", F.octet_length(content).alias("size"))
    placed = sizes.select("row", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    a = rows.join(placed, "row").select("file", "offset", "page_id", content.alias("content"))
    code = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    flipped = F.when(F.startswith(code, F.lit("00")), F.overlay("content", F.lit("~"), F.lit(20))).otherwise(F.col("content"))
    b = a.where(~(F.startswith(F.substring(code, 3, 3), F.lit("00")) & (F.substring(code, 5, 1) < "4"))).withColumn("content", flipped)
    return a, b


@query
def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _replicas(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(a, b)


SQL["op7_merkle_audit"] = r"""
WITH r AS (
  SELECT page_id, 'part-' || coalesce(CAST(page_id // 1000 AS VARCHAR), 'none') || '.warc' AS file, md5(coalesce(CAST(page_id AS VARCHAR), 'none')) AS code,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
      || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages),
o AS (
  SELECT *, CAST(coalesce(sum(strlen(content)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    code[3:4] = '00' AND code[5:5] < '4' AS lost FROM r)
SELECT file, "offset", CASE WHEN lost THEN 'missing' ELSE 'corrupt' END AS status, sha256(content) AS hash_a,
  CASE WHEN NOT lost THEN sha256(content[1:19] || '~' || content[21:]) END AS hash_b
FROM o WHERE lost OR code[1:2] = '00'
"""


@query
def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


@query
def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    profiles = langid.learn(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


SQL["op10_extendible_shards"] = f"""
WITH a AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    right('{'0' * 32}' || format('{{:b}}', ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8])::BIGINT), 32) AS address FROM documents),
s AS (SELECT d AS depth, address[1:d] AS prefix, count(*) AS shard_docs, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM a, range(33) t(d) GROUP BY ALL),
f AS (
  SELECT s.* FROM s LEFT JOIN s AS up ON up.depth = s.depth - 1 AND up.prefix = s.prefix[1 : s.depth - 1]
  WHERE (s.shard_bytes <= {sharding.SHARD_BYTES} OR s.shard_docs = 1) AND (s.depth = 0 OR (up.shard_bytes > {sharding.SHARD_BYTES} AND up.shard_docs > 1)))
SELECT doc_id, n_bytes, CASE WHEN prefix = '' THEN '*' ELSE prefix END AS shard, depth, shard_docs, shard_bytes, shard_bytes > {sharding.SHARD_BYTES} AS oversize
FROM a JOIN f ON a.address[1 : f.depth] = f.prefix
"""


def _crc32(key: str) -> str:
    """SQL for the unsigned CRC-32 of a number's decimals, bit by bit."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({key} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT)"""


def _ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest.audit(docs, lower, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
#: Nodes of the levels above a table of leaves, each node's siblings, and each leaf's path as a list of 'left|right'.
_TREE = """
{t}up AS (
  SELECT grp, 0 AS lvl, i, n, node FROM {leaves}
  UNION ALL SELECT grp, lvl + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY i)) FROM {t}up WHERE n > 1 GROUP BY grp, lvl, i // 16),
{t}sib AS (
  SELECT a.grp, a.lvl, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|' || coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS lr
  FROM {t}up a JOIN {t}up b ON a.grp = b.grp AND a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
{t}path AS (
  SELECT l.grp, l.i, list(s.lr ORDER BY s.lvl) AS path FROM {leaves} l JOIN {t}sib s ON l.grp = s.grp AND s.i = l.i // CAST(power(16, s.lvl) AS BIGINT) GROUP BY ALL),
{t}top AS (SELECT grp, node AS top FROM {t}up WHERE n = 1)"""

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS grp, {' || '.join(_FIELD(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head,
    {_FIELD('text')} AS body, {_FIELD(_ascii_lower('text'))} AS lowered, coalesce({_crc32('doc_id')} % 5 = 0, false) AS tampered FROM documents),
e AS (SELECT doc_id, source, grp, sha256(head || body) AS node, sha256(head || CASE WHEN tampered THEN lowered ELSE body END) AS claimed FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM e),
{_TREE.format(t='', leaves='leaves')},
roots AS (SELECT '' AS grp, grp AS src, top AS node, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM top),
{_TREE.format(t='r', leaves='roots')},
j AS (
  SELECT l.doc_id, l.source, l.node AS leaf, l.claimed, r.node AS subroot, rtop.top AS root, coalesce(p.path, []) || coalesce(rp.path, []) AS path
  FROM leaves l LEFT JOIN path p USING (grp, i) JOIN roots r ON r.src = l.grp LEFT JOIN rpath rp ON rp.i = r.i CROSS JOIN rtop),
o AS (
  SELECT doc_id, source, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: replace(x, '|', '')), '')) AS proof_sha256,
    list_reduce([claimed] || path, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM j)
SELECT *, folded_root = root AS verified FROM o
"""


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, role, text) and ids of the conversations as the query wants them: each begins with up to five
    turns of the conversation at the hundred below it. Places keep their gaps; only their order counts."""
    own = conversations.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).alias("pos")
    held = F.crc32(F.col("conv_id").cast("string")) % 6
    kept = own.select("conv_id", "role", "text", place).where(F.col("pos") > held)
    ids = own.select("conv_id").distinct()
    firsts = own.where("conv_id % 100 = 0").select("conv_id", "role", "text", place).where("pos <= 5").withColumnRenamed("conv_id", "anchor")
    begun = ids.withColumn("anchor", F.expr("conv_id - conv_id % 100")).join(firsts, "anchor").where(F.col("pos") <= held)
    return kept.unionByName(begun.select("conv_id", "role", "text", "pos")), ids


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(*_rebuilt(table(spark, sf_dir, "conversations")))


SQL["op12_prefix_trie"] = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS anchor, {_crc32('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.anchor AND k <= h
  UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM r),
m AS (
  SELECT conv_id, 0 AS d, 0 AS chars, '' AS node FROM c
  UNION ALL SELECT conv_id, d, length(text), sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) FROM n),
e AS (SELECT conv_id, max(d) AS last FROM m GROUP BY conv_id),
g AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last), '') AS ends
  FROM m JOIN e USING (conv_id) GROUP BY d, node),
u AS (SELECT g.*, pg.node AS up, pg.conv_id AS parent_conv_id FROM g LEFT JOIN m pm ON pm.conv_id = g.conv_id AND pm.d = g.d - 1 LEFT JOIN g pg ON pg.d = pm.d AND pg.node = pm.node),
k AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.up = u.node AND k.d = u.d),
s AS (
  SELECT a.d, a.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM f JOIN m a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.d, a.node)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.node = f.node
"""


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~langid.held_out()))
    scored = toxicity.score(docs, lexicon).withColumn("held_out", langid.held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"))
