"""N-gram Jaccard join with a token-group matrix.

Documents whose sets of word shingles link when their Jaccard similarity reaches num / den are put in components.

1. Documents with equal sets are one class from the start (keys of 128 bits), so exact copies cost nothing more.
2. A set is described by signature tokens (shingles.signatures): whole parts of its token space. Two linked sets
   share at least a known number of signatures, so a pair below that number need not be looked at. Signatures that
   occur once leave at once.
3. Similar documents are partitioned into groups: each is compared with those leaders of its signatures with which
   it shares most, and what links makes a group. Groups hold GROUP_SIZE documents at most; larger
   ones are cut.
4. The token-group matrix has a row per signature and group: the group's token union. Every document is a query
   against the groups of other components. The query-group overlap is counted on the matrix, and only groups where
   it reaches the bound are opened: their documents are compared with the query exactly, on whole shingle sets.
   A signature that occurs in more than COMMON components counts only between documents that hold so many of them
   that the bound could be met without any other; for a document that holds fewer, the bound falls by their number.
5. All links go into the components.

Nothing is lost at any step. Ids, of eight bytes each, are broadcast up to IDS_BYTES of them and joined beyond. Rows are numbered once, in a table, so that any frame may be
given.

Null texts and texts without words have empty sets, no links and themselves as component. Rows of one doc_id are one
document of several texts: a link of any is a link of it. A row with null doc_id keeps its links to itself: its
component is null. Repeated rows are kept. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofit.llm.common import Scratch, buffers, map_arrow, staged
from geofit.llm.components import components
from geofit.llm.shingles import Similar, rounds, set_keys, shingle_sets, signatures

GROUP_SIZE = 64
COMMON = 12
#: Documents of a signature that one leader is tried by, ways to choose the leaders, and leaders tried by a document.
CELL = 8
LEADERS = 6
TRIES = 10
IDS_BYTES = 4 << 20


def by_ids(rows: DataFrame, ids: DataFrame, how: str, name: str = "rid") -> DataFrame:
    """left_semi or left_anti join on ids, which are longs: their number gives their bytes."""
    return rows.join(F.broadcast(ids) if 8 * ids.count() <= IDS_BYTES else ids, name, how)


def _sets(rows: DataFrame, k: int, fields: list[tuple[str, pa.DataType]], ddl: str, make, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (rid, text) to what `make` gives for a block's (rids, tokens, offsets), and to the columns of rows to keep."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for lo, hi in rounds(offsets):
                tokens, at = shingle_sets(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], k)
                kept = [batch.column(2 + j).slice(lo, hi - lo) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in make(rids[lo:hi], tokens, at)], *kept], schema=schema)

    return map_arrow(rows.select("rid", "text", *keep), run, ddl)


def rooted(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rid, doc_id, n (size of the set), root (the same for all rows of a component), of docs (rid, doc_id, text) whose
    rids are the same at every reading."""
    similar, scratch = Similar(num, den), Scratch(docs.sparkSession)
    texts = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def keys(rids, tokens, at):
        return [rids, np.diff(at), *[x.view(np.int64) for x in set_keys(tokens, at)]]

    fields = [(c, pa.int64()) for c in ("rid", "n", "k1", "k2", "doc_id")]
    keyed = scratch.put("sets", _sets(texts, k, fields, "rid long, n long, k1 long, k2 long, doc_id long", keys, keep=("doc_id",)))
    classes = scratch.put("classes", keyed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("rep"), F.count("rid").alias("copies")))
    spare = keyed.join(classes, ["k1", "k2", "n"]).where("rid <> rep").select("rid")
    members = scratch.put("members", keyed.join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left").select("rid", "doc_id", "n", F.coalesce("rep", "rid").alias("rep")))
    spare = scratch.put("copies", spare)
    scratch.drop("sets", "classes")

    links = _links(by_ids(texts, spare, "left_anti"), k, similar)
    scratch.drop("copies")
    grouped = components(links)
    # Classes to documents: the rows of one doc_id are held together, and the least doc_id names the component.
    own = members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep")).drop("component")
    own = scratch.put("rooted", own.select("rid", "doc_id", "n", "root"))
    scratch.drop("members")
    split = own.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    several = own.join(split.select("doc_id", "a"), "doc_id").where("n > 0").select("a", F.col("root").alias("b"))
    joined = components(several)
    return own.join(joined.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")


def link(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    own = rooted(Scratch(docs.sparkSession).numbered("texts", docs.select("doc_id", "text"), "rid"), k, num, den)
    least = own.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = own.join(least, "root", "left")
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") == 0) | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the one of least doc_id stays (ties by place)."""
    docs = Scratch(docs.sparkSession).numbered("numbered", docs, "__rid")
    own = staged(rooted(docs.select(F.col("__rid").alias("rid"), "doc_id", "text"), k, num, den).where("n > 0"), "components")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best")).select(F.col("best.rid").alias("rid"))
    spare = staged(own.join(first, "rid", "left_anti").select("rid"), "near-duplicates")
    return by_ids(docs, spare.withColumnRenamed("rid", "__rid"), "left_anti", "__rid").drop("__rid")


def _linked(pairs: DataFrame, sets: DataFrame, similar: Similar) -> DataFrame:
    """Those of the pairs (a, b) of rids whose sets link."""
    left = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    enough = shared * (similar.num + similar.den) >= similar.num * (F.size("ta") + F.size("tb"))
    near = (F.size("ta") * similar.den >= F.size("tb") * similar.num) & (F.size("tb") * similar.den >= F.size("ta") * similar.num)
    return both.where(near).where(enough).select("a", "b")


def _leaders(shared: DataFrame) -> DataFrame:
    """rid, need, lead of each signature, for each of LEADERS ways to deal its documents to cells of about CELL. A cell is
    led by its first document in an order common to all signatures, so that similar documents meet it in several."""
    ways = shared.withColumn("way", F.explode(F.sequence(F.lit(1), F.lit(LEADERS))))
    ways = ways.withColumn("place", F.shiftrightunsigned(F.xxhash64("rid", "way"), 1))
    bits = F.greatest(F.ceil(F.log2(F.col("held") / CELL)), F.lit(0)).cast("int")
    ways = ways.withColumn("cell", F.floor(F.col("place") / F.pow(F.lit(2.0), 63 - bits)))
    w = Window.partitionBy("sign", "way", "cell")
    return ways.withColumn("lead", F.min(F.struct("place", "rid")).over(w)["rid"]).select("rid", "need", "lead")


def _links(texts: DataFrame, k: int, similar: Similar) -> DataFrame:
    """Links (a, b) between class representatives that join all linked classes into their components."""
    scratch = Scratch(texts.sparkSession)

    def signs(rids, tokens, at):
        doc, sign, need = signatures(tokens, at, similar)
        return [rids[doc], sign.view(np.int64), need.astype(np.int32)]

    def whole(rids, tokens, at):
        return [rids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))]

    signed = _sets(texts, k, [("rid", pa.int64()), ("sign", pa.int64()), ("need", pa.int32())], "rid long, sign long, need int", signs)
    w = Window.partitionBy("sign")
    shared = signed.withColumn("first", F.min("rid").over(w)).withColumn("last", F.max("rid").over(w)).withColumn("held", F.count("rid").over(w)).where("first <> last")
    shared = scratch.put("signatures", shared)
    # A document that shares too few signatures with all others together has no partner.
    able = shared.groupBy("rid", "need").agg(F.count("sign").alias("n")).where("n >= need").select("rid").distinct()
    able = scratch.put("able", able)
    shared = scratch.put("able-signatures", by_ids(shared, able, "left_semi"))
    scratch.drop("signatures")
    sets = scratch.put("candidate-sets", _sets(by_ids(texts, able, "left_semi"), k, [("rid", pa.int64()), ("tokens", pa.list_(pa.int64()))], "rid long, tokens array<long>", whole))

    # Groups of similar documents: each with the leaders it shares most signatures with.
    led = shared.select("rid", "need", F.explode(F.array("first", "last")).alias("lead")).unionByName(_leaders(shared)).where("rid <> lead")
    tried = led.groupBy("rid", "lead").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need")
    best = tried.groupBy("rid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "lead")), False), 1, TRIES).alias("best"))
    pairs = best.select(F.col("rid").alias("a"), F.explode("best.lead").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first_links = scratch.put("jaccard-links", _linked(pairs, sets, similar))
    found = components(first_links)
    groups = able.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    sizes = groups.groupBy("component").agg(F.count("rid").alias("size"))
    chunk = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / GROUP_SIZE))
    groups = scratch.put("groups", groups.join(sizes, "component").select("rid", "component", F.xxhash64("component", chunk).alias("grp")))

    rows = scratch.put("grouped-signatures", shared.select("rid", "need", "sign").join(groups, "rid"))
    scratch.drop("able-signatures")
    matrix = rows.groupBy("sign", "component", "grp").agg(F.min("need").alias("need"))
    spread = matrix.select("sign", "component").distinct().groupBy("sign").agg(F.count(F.lit(1)).alias("n_components")).where("n_components > 1")
    rows = scratch.put("open-signatures", rows.join(spread, "sign"))
    scratch.drop("grouped-signatures")
    common = F.col("n_components") > COMMON
    own_common = rows.groupBy("rid", "need").agg(F.count_if(common).alias("n_common"))
    rows = rows.join(own_common, ["rid", "need"]).where(~common | (F.col("n_common") >= F.col("need")))
    # What a linked pair shares at least of the rows that are left: a document without its common signatures misses those.
    rows = rows.withColumn("ask", F.when(F.col("n_common") >= F.col("need"), F.col("need")).otherwise(F.col("need") - F.col("n_common")))
    rows = scratch.put("queries", rows)
    scratch.drop("open-signatures")
    asks = rows.groupBy("grp", "need").agg(F.min("ask").alias("grp_ask"))
    matrix = scratch.put("token-group-matrix", rows.select("sign", "component", "grp", "need").distinct().join(asks, ["grp", "need"]))
    met = rows.select("sign", "rid", F.col("component").alias("own"), "need", "ask").join(matrix.select("sign", "component", "grp", F.col("need").alias("grp_need"), "grp_ask"), "sign").where("component < own and need = grp_need")
    opened = met.groupBy("rid", "grp", "need").agg(F.count("sign").alias("n"), F.min(F.least("ask", "grp_ask")).alias("least")).where("n >= least").select("rid", "grp").distinct()
    inside = groups.select(F.col("rid").alias("b"), "grp")
    more = _linked(opened.withColumnRenamed("rid", "a").join(inside, "grp").select("a", "b").distinct(), sets, similar)
    links = scratch.put("links", first_links.unionByName(more))
    scratch.drop(*[name for name in scratch.paths if name != "links"])
    return links
