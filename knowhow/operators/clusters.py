"""Clusters of documents that repeat each other's work or raise the same issue."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.functions.vector import unit
from knowhow.operators import blocks, pivots, similarity
from knowhow.session import cut_lineage, written


def document_department(documents: DataFrame, authors: DataFrame) -> DataFrame:
    """(doc_id, dept_id): a proposal's department is its proposer's at the time, a project's the owning one."""
    proposer = authors.where("role = 'proposer'").groupBy("doc_id").agg(F.max_by("dept_id_at_time", "emp_id").alias("p"))
    return documents.join(proposer, "doc_id", "left").select(
        "doc_id", F.coalesce("p", F.when(F.col("doc_type") == "project", F.col("owner_dept_id"))).alias("dept_id")
    )


def select_sections(sections: DataFrame, roles: list[str]) -> DataFrame:
    return sections.where(F.col("section_role").isin(*roles))


def _under_documents(sections: DataFrame) -> DataFrame:
    """Section vectors under their document's id, so that pairs come out as pairs of documents."""
    return sections.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec"))


def document_pairs(sections: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b: best similarity of two documents' sections, where it reaches the threshold."""
    p = similarity.best_pairs_above(_under_documents(sections), threshold)
    return p.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "sim")


def document_links(sections: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: edges that connect the documents that ``document_pairs`` connects."""
    return similarity.links_above(_under_documents(sections), threshold, drop_self=True).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def _with_documents(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("section_id").alias("id"), F.col("embedding").alias("vec"), F.array("doc_id").alias("grp"))


def section_pairs(sections: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b: sections of different documents whose similarity reaches the threshold."""
    p = similarity.pairs_above(_with_documents(sections), threshold)
    return p.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "sim")


def section_links(sections: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: edges that connect the sections that ``section_pairs`` connects."""
    return similarity.links_above(_with_documents(sections), threshold).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def pair_percentiles(sections: DataFrame, percents=(99.0, 99.5), block_rows: int = 2048) -> DataFrame:
    """(pct, sim): linearly interpolated percentiles over all document pairs, in one pass.

    The task that holds two blocks of documents forms the best similarity of each document pair and returns how often each
    rounded value occurs. Only pairs with a document that is larger than a block leave their task, to be completed.
    """
    rows = sections.select("section_id", "doc_id", "embedding", F.lit(0).cast("long").alias("cluster"), F.lit(0).alias("component"))
    found = _tiles(rows, _count_tile, "a long, b long, bin long, n long", block_rows)
    completed = found.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("bin").alias("bin")).select("bin", F.lit(1).cast("long").alias("n"))
    bins = found.where("a IS NULL").select("bin", "n").unionByName(completed).groupBy("bin").agg(F.sum("n").alias("n"))
    return similarity.percentiles_of(bins.select((F.col("bin") / 10**similarity.DIGITS).alias("sim"), "n"), percents)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its lowest node.

    Alternating star contraction: each round hangs every node's neighbours on the lowest one it sees, so the
    number of rounds grows with the logarithm of the graph; rounds go on until nothing changes. Lowest neighbours
    are found by aggregation, never by gathering a node's edges, and every round is checkpointed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == now:
            break
        state = now
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def mutual_neighbours(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Pairs in which each document is among the other's k best. Pairs below the threshold can be left out
    beforehand: they rank behind all others and would not become edges."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    top = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "sim")
    other = top.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return top.where("a < b").join(other, ["a", "b"], "left_semi")


def complete_linkage(pairs: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, cluster): clusters merge while every pair between them reaches the threshold.

    All pairs of clusters that are each other's best partner merge in one round; this gives the same tree as one merge at a time. Rounds
    go on until none merges. A pair of clusters that lacks a pair of documents never merges, nor does what grows out of it, so only
    links of complete pairs are kept for the next round.
    """
    links = written(pairs.where(F.col("sim") >= threshold).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("sim").alias("link")))
    labels = documents.select("doc_id", F.col("doc_id").alias("cluster"))
    while True:
        labels, moves = _merge_best(labels, links)
        if moves is None:
            return labels
        links = written(_complete_links(links, moves))


def _complete_links(links, moves):
    """(x, y, link): lowest links of the clusters after a round, of those pairs whose parts (two of a merged cluster) are all linked."""
    found = _renamed(links, moves)
    still = ~(F.col("x_merged") | F.col("y_merged"))
    merged = found.where(~still).groupBy("x", "y", "x_merged", "y_merged").agg(F.count(F.lit(1)).alias("n"), F.min("link").alias("link"))
    parts = F.when(F.col("x_merged"), 2).otherwise(1) * F.when(F.col("y_merged"), 2).otherwise(1)
    return found.where(still).select("x", "y", "link").unionByName(merged.where(F.col("n") == parts).select("x", "y", "link"))


def average_linkage(sections: DataFrame, threshold: float, block_rows: int = 1024, at_once: int = 2048) -> DataFrame:
    """(doc_id, cluster): clusters merge while the mean similarity of their document pairs reaches the threshold.

    Means that reach it are kept from round to round. Clusters that stayed as they were keep theirs, and a merged cluster's mean with
    another one is never above both its parts', so a round forms the means of merged clusters only, with clusters that still have one.
    When no more than ``at_once`` clusters have one, their sums are a matrix that one task merges to the end (the same merges).
    """
    links = written(document_pairs(sections, threshold).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("sim").alias("link")))
    labels = sections.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("cluster"))
    parts = sections.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_parts"))
    rows = sections.select("section_id", "doc_id", "embedding").join(parts, "doc_id").withColumn("split", F.col("n_parts") > 1)
    part = F.when(F.col("split"), F.pmod(F.xxhash64("section_id"), F.col("n_parts"))).otherwise(F.lit(0))
    rows = written(rows.select("doc_id", "embedding", "split", part.alias("part")))
    while True:
        open_ = written(links.select(F.explode(F.array("x", "y")).alias("cluster")).distinct())
        n = open_.count()
        if not n:
            return labels
        if n <= at_once:
            sums = _cluster_sums(rows.join(labels, "doc_id").join(open_.withColumn("merged", F.lit(True)), "cluster"), -np.inf, block_rows)
            moves = sums.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_merged_to_the_end(threshold), "cluster long, into long")
            return labels.join(moves, "cluster", "left").select("doc_id", F.coalesce("into", "cluster").alias("cluster"))
        labels, moves = _merge_best(labels, links)
        found = written(_renamed(links, moves))
        met = found.where("x_merged OR y_merged").select(F.explode(F.array(
            F.struct(F.col("x").alias("cluster"), F.col("x_merged").alias("merged")), F.struct(F.col("y").alias("cluster"), F.col("y_merged").alias("merged")),
        )).alias("c")).select("c.*").distinct()
        kept = found.where("NOT x_merged AND NOT y_merged").select("x", "y", "link")
        sums = _cluster_sums(rows.join(labels, "doc_id").join(met, "cluster"), threshold, block_rows)
        fresh = sums.select("x", "y", (F.col("total") / F.col("pairs")).alias("link")).where(F.col("link") >= threshold - 1e-9)
        links = written(kept.unionByName(fresh))


def average_linkage_of_sections(sections: DataFrame, threshold: float, block_rows: int = 4096, at_once: int = 1 << 16) -> DataFrame:
    """(section_id, doc_id, cluster): sections merge while the mean similarity between two clusters reaches the threshold;
    two sections of one document count as 0. The threshold must be above 0.

    The mean between clusters is the product of their vector sums, less what sections of common documents add, over the
    product of their sizes. So a round needs only sums per cluster and per cluster and document, which add up
    when clusters merge; sections' vectors are read once. A merged cluster's mean with another one is never above both its parts', so
    links are kept from round to round as in ``average_linkage``, and sums meet in blocks instead of a row with both sums per pair of clusters.
    When the sums of the clusters that still have a link are no more than ``at_once`` rows, and the links 32 times as many, one task merges to the end
    (the same merges).
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0: only clusters with a similar pair are looked at")
    links = written(section_pairs(sections, threshold).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("sim").alias("link")))
    items = sections.select(F.col("section_id").alias("doc_id"), F.col("doc_id").alias("document"))
    labels = cut_lineage(items.select("doc_id", F.col("doc_id").alias("cluster")))
    parts = sections.join(_ends(links).select(F.col("cluster").alias("section_id")), "section_id", "left_semi").select(
        F.col("section_id").alias("cluster"), F.col("doc_id").alias("document"), unit("embedding").alias("total"), F.lit(1).cast("long").alias("n")
    )
    first = True
    while True:
        labels, moves = _merge_best(labels, links)
        if moves is None:
            break
        found = written(_renamed(links, moves))
        if first:  # the links so far are rounded
            found, first = found.withColumn("x_merged", F.lit(True)).withColumn("y_merged", F.lit(True)), False
        parts = parts.join(moves, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster"))  # a cluster is named after its lowest section
        parts = parts.join(_ends(found), "cluster", "left_semi").groupBy("cluster", "document").agg(_vector_sum("total").alias("total"), F.sum("n").alias("n"))
        parts = written(parts)
        met = found.where("x_merged OR y_merged").select(F.explode(F.array(
            F.struct(F.col("x").alias("cluster"), F.col("x_merged").alias("merged")), F.struct(F.col("y").alias("cluster"), F.col("y_merged").alias("merged")),
        )).alias("c")).select("c.*").distinct()
        kept = found.where("NOT x_merged AND NOT y_merged").select("x", "y", "link")
        sums = _section_sums(parts.join(met, "cluster"), threshold - 1e-9, block_rows)
        links = written(kept.unionByName(sums.select("x", "y", (F.col("total") / F.col("pairs")).alias("link"))))
        open_ = _sums_and_common(parts.join(_ends(links), "cluster", "left_semi"))
        if 0 < open_.count() <= at_once and links.count() <= 32 * at_once:
            alone, ends = open_.withColumn("one", F.lit(1)).groupBy("one"), links.withColumn("one", F.lit(1)).groupBy("one")
            moves = alone.cogroup(ends).applyInArrow(_sections_to_the_end(threshold), "cluster long, into long")
            labels = labels.join(moves, "cluster", "left").select("doc_id", F.coalesce("into", "cluster").alias("cluster"))
            break
    return labels.join(items, "doc_id").select(F.col("doc_id").alias("section_id"), F.col("document").alias("doc_id"), "cluster")


def _ends(links):
    return links.select(F.explode(F.array("x", "y")).alias("cluster")).distinct()


def _section_sums(rows, threshold, block_rows):
    """(x, y, total, pairs): sum and number of the similarities of the sections of two clusters of which one is merged, x < y, where the mean
    reaches the threshold.

    ``rows``: (cluster, document, total, n, merged). A block holds whole clusters: their sums, and those by document of documents that are in
    several clusters.
    """
    both = _sums_and_common(written(rows), "merged")
    whole = both.where("document IS NULL")
    counts = {r["merged"]: r["n"] for r in whole.groupBy("merged").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n")).collect()}
    n_blocks = F.when(F.col("merged"), F.lit(counts.get(True, 1))).otherwise(F.lit(counts.get(False, 1)))
    both = both.withColumn("own", F.pmod(F.xxhash64("cluster"), n_blocks).cast("int"))
    stored = blocks.packed(both, ["merged", "own"], sum(counts.values()))
    return blocks.pair_up(stored, "l_merged AND (NOT r_merged OR l_own <= r_own)", _sum_tile(threshold), "x long, y long, total double, pairs long")


def _sums_and_common(parts, *more):
    """(cluster, *more, total, n, document): a row per cluster without a document, and the rows of documents that are in several clusters."""
    several = parts.where("document IS NOT NULL").groupBy("document").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("document")
    whole = parts.groupBy("cluster", *more).agg(_vector_sum("total").alias("total"), F.sum("n").alias("n"))
    whole = whole.withColumn("document", F.lit(None).cast("long"))
    return written(whole.unionByName(parts.join(several, "document", "left_semi").select(whole.columns)))


_SUM_SCHEMA = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("total", pa.float64()), ("pairs", pa.int64())])


def _cluster_rows(table):
    """Ids, sums and sizes of a block's clusters, and by document: documents, places of their clusters, sums."""
    table = table.combine_chunks()
    ids, n = table.column("cluster").to_numpy(), table.column("n").to_numpy()
    mat = table.column("total").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    part = table.column("document").is_valid().to_numpy()
    order = np.argsort(ids[~part], kind="stable")
    known = ids[~part][order]
    documents = table.column("document").filter(pa.array(part)).to_numpy()
    by = np.argsort(documents, kind="stable")
    return known, mat[~part][order], n[~part][order], documents[by], np.searchsorted(known, ids[part][by]), mat[part][by]


def _products(left, right, i, j, step=1 << 15):
    """Products of the rows ``i`` of one side with the rows ``j`` of the other, some at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", left[i[at : at + step]], right[j[at : at + step]])
    return out


def _sums_between(left, right, threshold, step=1 << 16):
    """Places of the clusters of the two sides, sum and number of their sections' similarities, where the mean reaches the threshold.

    A side is (ids, sums, sizes, and by document in their order: documents, places of their clusters, sums).
    """
    lid, lmat, ln, ldoc, lat, lpart = left
    rid, rmat, rn, rdoc, rat, rpart = right
    i, j, _ = similarity._reached(lmat / ln[:, None], rmat / rn[:, None], threshold, 12)
    low = np.searchsorted(rdoc, ldoc)
    many = np.searchsorted(rdoc, ldoc, "right") - low
    ends, at, common, less = np.cumsum(many), 0, [np.zeros(0, np.int64)], [np.zeros(0)]
    while at < len(ldoc):  # what sections of common documents add
        last = max(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right"), at + 1)
        m = many[at:last]
        a, b = np.repeat(np.arange(at, last), m), np.repeat(low[at:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        pair, place = np.unique(lat[a] * len(rid) + rat[b], return_inverse=True)
        common.append(pair)
        less.append(np.bincount(place, weights=_products(lpart, rpart, a, b), minlength=len(pair)))
        at = last
    common, place = np.unique(np.concatenate(common), return_inverse=True)
    less = np.bincount(place, weights=np.concatenate(less), minlength=len(common))
    alone = ~np.isin(i * len(rid) + j, common)
    i, j = np.r_[i[alone], common // len(rid)], np.r_[j[alone], common % len(rid)]
    total, pairs = _products(lmat, rmat, i, j) - np.r_[np.zeros(alone.sum()), less], ln[i] * rn[j]
    keep = total >= threshold * pairs
    return i[keep], j[keep], total[keep], pairs[keep]


def _sum_tile(threshold):
    def run(key, left, right):
        left, right = _cluster_rows(left), _cluster_rows(right)
        i, j, total, pairs = _sums_between(left, right, threshold)
        x, y = left[0][i], right[0][j]
        keep = x < y if key["l_own"] == key["r_own"] and key["r_merged"] else x != y
        x, y = x[keep], y[keep]
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y), "total": total[keep], "pairs": pairs[keep]}, schema=_SUM_SCHEMA)

    return run


def _sections_to_the_end(threshold):
    """For clusters' sums and their links: the cluster that each ends in. Best partners merge as in ``_merge_best``."""
    def run(rows, links):
        ids, mat, n, doc, at, part = _cluster_rows(rows)
        into, at = np.arange(len(ids)), at.copy()
        mat, n = mat.copy(), n.copy()
        x, y, link = np.searchsorted(ids, links.column("x").to_numpy()), np.searchsorted(ids, links.column("y").to_numpy()), links.column("link").to_numpy()
        while len(x):
            me, one, two, value = np.r_[x, y], np.r_[x, x], np.r_[y, y], np.round(np.r_[link, link], 9)
            order = np.lexsort((two, one, -value, me))
            best = order[np.r_[True, np.diff(me[order]) != 0]]
            pair, times = np.unique(one[best] * len(ids) + two[best], return_counts=True)
            a, b = pair[times == 2] // len(ids), pair[times == 2] % len(ids)
            if not len(a):
                break
            mat[a] += mat[b]
            n[a] += n[b]
            now = np.arange(len(ids))
            now[b] = a
            into, at = now[into], now[at]
            merged = np.zeros(len(ids), bool)
            merged[a] = True
            x, y = now[x], now[y]
            met = np.unique(np.r_[x[merged[x] | merged[y]], y[merged[x] | merged[y]]])
            still = ~(merged[x] | merged[y])
            x, y, link = x[still], y[still], link[still]
            sides = []
            for some in (met[merged[met]], met):
                mine = np.isin(at, some)
                sides.append((some, mat[some], n[some], doc[mine], np.searchsorted(some, at[mine]), part[mine]))
            if not len(met):
                break
            i, j, total, pairs = _sums_between(*sides, threshold - 1e-9)
            i, j = sides[0][0][i], met[j]
            new = np.where(merged[j], i < j, i != j)
            x, y = np.r_[x, np.minimum(i, j)[new]], np.r_[y, np.maximum(i, j)[new]]
            link = np.r_[link, (total / pairs)[new]]
        return pa.table({"cluster": ids, "into": ids[into]})

    return run


def _vector_sum(column):
    """Sum of arrays by place, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column).cast("array<double>"))))


def _merge_best(labels, joined):
    """Merge every pair of clusters that are each other's best partner (ties: lowest pair): the labels, and what was merged
    (cluster, into) or None."""
    j = joined.withColumn("link", F.round("link", 9))
    both = j.select("x", "y", "link", F.col("x").alias("me")).unionByName(j.select("x", "y", "link", F.col("y").alias("me")))
    best = both.groupBy("me").agg(
        F.max_by(F.struct("x", "y"), F.struct("link", -F.col("x"), -F.col("y"))).alias("b")
    ).select("me", "b.x", "b.y")
    mutual = best.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    move = written(mutual.select(F.col("y").alias("cluster"), F.col("x").alias("into")))
    if not move.limit(1).count():
        return labels, None
    labels = labels.join(move, "cluster", "left").select("doc_id", F.coalesce("into", "cluster").alias("cluster"))
    return written(labels), move


def _renamed(links, moves):
    """(x, y, link, x_merged, y_merged): links of clusters, x < y, under the names they have after a round, and which of the two it merged."""
    names = moves.unionByName(moves.select(F.col("into").alias("cluster"), "into"))
    for side in ("x", "y"):
        now = names.select(F.col("cluster").alias(side), F.col("into").alias(f"now_{side}"))
        links = links.join(now, side, "left")
    one = F.struct(F.coalesce("now_x", "x").alias("id"), F.col("now_x").isNotNull().alias("merged"))
    two = F.struct(F.coalesce("now_y", "y").alias("id"), F.col("now_y").isNotNull().alias("merged"))
    links = links.select("link", F.least(one, two).alias("l"), F.greatest(one, two).alias("r")).where("l.id <> r.id")
    return links.select(F.col("l.id").alias("x"), F.col("r.id").alias("y"), "link", F.col("l.merged").alias("x_merged"), F.col("r.merged").alias("y_merged"))


_MEAN_SCHEMA = pa.schema([
    ("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("total", pa.float64()), ("pairs", pa.int64()),
])
_COUNT_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])


def _doc_matrix(table):
    """Unit vectors sorted by document; per document its first row, id, cluster and whether it is split."""
    docs = table.column("doc_id").to_numpy()
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mat = flat.reshape(len(docs), -1)[order]
    length = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    length[length == 0] = 1.0
    ids, start = np.unique(docs, return_index=True)
    first = order[start]
    split = table.column("split").combine_chunks().to_numpy(zero_copy_only=False)[first]
    return mat / length, start, ids, table.column("cluster").to_numpy()[first], split


def _document_sims(key, left, right):
    """Documents of the two blocks and, per pair of them that counts here, row, column, best similarity, and whether it is final."""
    lm, ls, ld, lc, lsplit = _doc_matrix(left)
    rm, rs, rd, rc, rsplit = _doc_matrix(right)
    sim = np.round(lm @ rm.T, similarity.DIGITS)
    sim = np.maximum.reduceat(np.maximum.reduceat(sim, ls, axis=0), rs, axis=1)
    same_block = key[0] == key[1]
    i, j = np.nonzero(ld[:, None] < rd[None, :] if same_block else ld[:, None] != rd[None, :])
    a, b = np.minimum(ld[i], rd[j]), np.maximum(ld[i], rd[j])
    return a, b, lc[i], rc[j], sim[i, j], lsplit[i] | rsplit[j]


def _count_tile(key, left, right):
    """How often each best similarity occurs; pairs with a split document one by one."""
    if not len(left) or not len(right):
        return _empty(_COUNT_SCHEMA)
    a, b, _, _, s, part = _document_sims(key, left, right)
    bins = np.rint(s * 10**similarity.DIGITS).astype(np.int64)
    values, counts = np.unique(bins[~part], return_counts=True)
    n, m = len(values), int(part.sum())
    return pa.table(
        {
            "a": pa.array([None] * n + a[part].tolist(), pa.int64()), "b": pa.array([None] * n + b[part].tolist(), pa.int64()),
            "bin": np.concatenate([values, bins[part]]), "n": np.concatenate([counts, np.ones(m)]).astype(np.int64),
        },
        schema=_COUNT_SCHEMA,
    )


_LOW_SCHEMA = pa.schema([("cluster", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.float64())])


def _low_tile(key, left, right):
    """The lowest similarity of two documents of a cluster; pairs with a split document one by one."""
    if not len(left) or not len(right):
        return _empty(_LOW_SCHEMA)
    lm, ls, ld, lc, lsplit = _doc_matrix(left)
    rm, rs, rd, _, rsplit = _doc_matrix(right)
    sim = lm @ rm.T
    if len(ls) < len(lm):
        sim = np.maximum.reduceat(sim, ls, axis=0)
    if len(rs) < len(rm):
        sim = np.maximum.reduceat(sim, rs, axis=1)
    _, i, j = np.intersect1d(ld, rd, return_indices=True)
    sim[i, j] = np.inf
    part = lsplit[:, None] | rsplit[None, :] if lsplit.any() or rsplit.any() else np.zeros((1, 1), dtype=bool)
    low = np.where(part, np.inf, sim).min()
    i, j = np.nonzero(part & (sim < np.inf)) if part.any() else (np.zeros(0, dtype=int),) * 2
    whole = [float(np.round(low, similarity.DIGITS))] if low < np.inf else []
    n = len(whole) + len(i)
    return pa.table(
        {
            "cluster": np.full(n, lc[0]), "a": pa.array([None] * len(whole) + np.minimum(ld[i], rd[j]).tolist(), pa.int64()),
            "b": pa.array([None] * len(whole) + np.maximum(ld[i], rd[j]).tolist(), pa.int64()),
            "low": np.concatenate([whole, np.round(sim[i, j], similarity.DIGITS)]),
        },
        schema=_LOW_SCHEMA,
    )


def _empty(schema):
    return pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)


def _by_cluster(table):
    """Unit vectors sorted by cluster and document; per document its first row, id, cluster and whether it is split; per cluster its
    first document, id and whether all of it is here."""
    table = table.combine_chunks()
    docs, clusters = table.column("doc_id").to_numpy(), table.column("cluster").to_numpy()
    order = np.lexsort((docs, clusters))
    mat = pivots.units(table.column("embedding").combine_chunks())[order]
    docs, clusters = docs[order], clusters[order]
    start = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (clusters[1:] != clusters[:-1])])
    of = clusters[start]
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    split = table.column("split").to_numpy(zero_copy_only=False)[order][start]
    whole = table.column("whole").to_numpy(zero_copy_only=False)[order][start][at]
    return mat, start, docs[start], of, split, at, of[at], whole


def _mean_tile(threshold):
    """Sums of the similarities of two blocks' documents by pair of clusters, those that are final here only if their mean reaches the
    threshold; pairs with a split document one by one."""
    def run(key, left, right):
        lm, ls, ld, lc, lsplit, lat, lid, lwhole = _by_cluster(left)
        rm, rs, rd, rc, rsplit, rat, rid, rwhole = _by_cluster(right)
        sim = np.round(lm @ rm.T, similarity.DIGITS)
        if len(ls) < len(lm):
            sim = np.maximum.reduceat(sim, ls, axis=0)
        if len(rs) < len(rm):
            sim = np.maximum.reduceat(sim, rs, axis=1)
        same_block = key["l_own"] == key["r_own"] and key["l_merged"] == key["r_merged"]
        i = j = np.zeros(0, dtype=int)
        if lsplit.any() or rsplit.any():
            part = lsplit[:, None] | rsplit[None, :]
            i, j = np.nonzero(part & (lc[:, None] < rc[None, :] if same_block else lc[:, None] != rc[None, :]))
            alone = sim[i, j]
            sim[part] = 0.0
        else:
            alone = np.zeros(0)
        total = np.add.reduceat(np.add.reduceat(sim, lat, axis=0), rat, axis=1)
        pairs = np.add.reduceat((~lsplit).astype(np.int64), lat)[:, None] * np.add.reduceat((~rsplit).astype(np.int64), rat)[None, :]
        wanted = (lid[:, None] < rid[None, :] if same_block else lid[:, None] != rid[None, :]) & (pairs > 0)
        wanted &= (total >= (threshold - 1e-9) * pairs) | ~(lwhole[:, None] & rwhole[None, :])
        p, q = np.nonzero(wanted)
        x, y = np.r_[lid[p], lc[i]], np.r_[rid[q], rc[j]]
        none = [None] * len(p)
        return pa.table(
            {
                "x": np.minimum(x, y), "y": np.maximum(x, y),
                "a": pa.array(none + np.minimum(ld[i], rd[j]).tolist(), pa.int64()), "b": pa.array(none + np.maximum(ld[i], rd[j]).tolist(), pa.int64()),
                "total": np.r_[total[p, q], alone], "pairs": np.r_[pairs[p, q], np.ones(len(i), dtype=np.int64)],
            },
            schema=_MEAN_SCHEMA,
        )

    return run


def _cluster_sums(rows, threshold, block_rows):
    """(x, y, total, pairs): sum and number of the similarities of the documents of two clusters of which one is merged; at least
    those whose mean reaches the threshold.

    ``rows``: (doc_id, embedding, split, part, cluster, merged). A block holds whole clusters, so that its task knows their means and gives
    those that count. A cluster with more rows than a block is split, a document too: sums for these are put together.
    """
    rows = written(rows)
    n = {r["merged"]: r["n"] for r in rows.groupBy("merged").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n")).collect()}
    if not n.get(True):
        return rows.sparkSession.createDataFrame([], "x long, y long, total double, pairs long")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("c_parts"))
    place = F.when(F.col("c_parts") > 1, F.pmod(F.xxhash64("doc_id", "part"), F.col("c_parts"))).otherwise(F.lit(0))
    n_blocks = F.when(F.col("merged"), F.lit(n[True])).otherwise(F.lit(n.get(False, 1)))
    dealt = rows.join(sizes, "cluster").select(
        "merged", F.pmod(F.xxhash64("cluster", place), n_blocks).cast("int").alias("own"), "doc_id", "embedding", "cluster", "split",
        (F.col("c_parts") == 1).alias("whole"),
    )
    stored = blocks.packed(dealt, ["merged", "own"], sum(n.values()))
    found = blocks.pair_up(stored, "l_merged AND (NOT r_merged OR l_own <= r_own)", _mean_tile(threshold),
                           "x long, y long, a long, b long, total double, pairs long")
    found = found.groupBy("x", "y", "a", "b").agg(
        F.when(F.col("a").isNull(), F.sum("total")).otherwise(F.max("total")).alias("total"),
        F.when(F.col("a").isNull(), F.sum("pairs")).otherwise(F.lit(1)).alias("pairs"),
    )
    return found.groupBy("x", "y").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def _merged_to_the_end(threshold):
    """For the sums of all pairs of some clusters: the cluster that each ends in. Best partners merge as in ``_merge_best``."""
    def run(table):
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        names, place = np.unique(np.r_[x, y], return_inverse=True)
        i, j = place[: len(x)], place[len(x) :]
        total, pairs = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
        total[i, j] = total[j, i] = table.column("total").to_numpy()
        pairs[i, j] = pairs[j, i] = table.column("pairs").to_numpy()
        alive, into = np.arange(len(names)), np.arange(len(names))
        while len(alive):
            link = np.full(total.shape, -np.inf)
            np.divide(total, pairs, out=link, where=pairs > 0)
            np.fill_diagonal(link, -np.inf)
            link = np.where(link >= threshold - 1e-9, np.round(link, 9), -np.inf)
            best = link.argmax(axis=1)  # the first of equal ones is the lowest pair
            here = np.arange(len(alive))
            first = here[(best[best] == here) & (here < best) & (link[here, best] > -np.inf)]
            if not len(first):
                break
            second = best[first]
            into[alive[second]] = alive[first]
            for m in (total, pairs):
                m[first] += m[second]
                m[:, first] += m[:, second]
            stay = np.delete(here, second)
            total, pairs, alive = total[np.ix_(stay, stay)], pairs[np.ix_(stay, stay)], alive[stay]
        while (into[into] != into).any():
            into = into[into]
        return pa.table({"cluster": names, "into": names[into]})

    return run


def _tiles(labelled, kernel, schema, block_rows=1024, group="component"):
    """``labelled``: (section_id, doc_id, embedding, cluster, component). A group is cut into blocks of whole documents
    by hash; pairs of blocks of the same group meet in one task. A document with more sections than a block is split.
    """
    sizes = labelled.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    parts = labelled.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_parts"))
    rows = labelled.join(sizes, group).join(parts, "doc_id").withColumn("split", F.col("n_parts") > 1)
    part = F.when(F.col("split"), F.pmod(F.xxhash64("section_id"), F.col("n_parts"))).otherwise(F.lit(0))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", part), F.col("blocks")).cast("int"))
    rows = rows.select(F.col(group).alias("g"), "own", (F.col("blocks") > 1).alias("many"), "doc_id", "embedding", "cluster", "split")
    stored = blocks.packed(rows, ["g", "own", "many"])

    def one(key, table):
        return kernel((0, 0), table, table)

    def two(key, left, right):
        return kernel((key["l_own"], key["r_own"]), left, right)

    small = blocks.each(stored.where("not many"), one, schema)
    return small.unionByName(blocks.pair_up(stored.where("many"), "l_g = r_g AND l_own <= r_own", two, schema))


def valid_clusters(clusters: DataFrame, sections: DataFrame, departments: DataFrame, min_docs: int, min_depts: int | None,
                   block_rows: int = 1024) -> DataFrame:
    """(cluster, size, dept_count, min_sim) of clusters with enough documents and departments.

    ``clusters``: (doc_id, cluster). min_sim is the lowest similarity of two documents in the cluster.
    """
    c = clusters.join(departments, "doc_id", "left").groupBy("cluster").agg(
        F.count_distinct("doc_id").alias("size"),
        (F.count_distinct("dept_id") + F.max(F.col("dept_id").isNull().cast("int"))).alias("dept_count"),
    ).where(F.col("size") >= min_docs)
    if min_depts:
        c = c.where(F.col("dept_count") >= min_depts)
    rows = sections.select("section_id", "doc_id", "embedding").join(clusters, "doc_id").join(c.select("cluster"), "cluster", "left_semi")
    rows = rows.withColumn("component", F.col("cluster"))
    found = _tiles(rows, _low_tile, "cluster long, a long, b long, low double", block_rows)
    # A pair with a split document is as alike as the best of its parts.
    completed = found.where("a IS NOT NULL").groupBy("cluster", "a", "b").agg(F.max("low").alias("low")).select("cluster", "low")
    low = found.where("a IS NULL").select("cluster", "low").unionByName(completed)
    return c.join(low.groupBy("cluster").agg(F.min("low").alias("min_sim")), "cluster")


def summary(valid: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Number of clusters, largest, five largest sizes, share of documents in a cluster, lowest min_sim."""
    top = valid.orderBy(F.desc("size")).limit(5).agg(F.sort_array(F.collect_list("size"), asc=False).alias("l")).select(
        F.array_join("l", ",").alias("top_sizes"), F.lit(1).alias("_one")
    )
    s = valid.agg(
        F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.sum("size").alias("covered"),
        F.min("min_sim").alias("min_of_min"),
    ).withColumn("_one", F.lit(1))
    total = n_docs.select(F.col("n_docs"), F.lit(1).alias("_one"))
    return s.join(top, "_one").join(total, "_one").select(
        "clusters", "largest", "top_sizes", (F.col("covered") / F.col("n_docs")).alias("coverage"), "min_of_min"
    )


def link_checks(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(group_id, linked): whether all documents of a group are in one cluster. ``groups``: (group_id, doc_id)."""
    g = groups.join(clusters, "doc_id", "left").groupBy("group_id").agg(
        F.count_distinct("cluster").alias("n"), F.max(F.col("cluster").isNull()).alias("missing")
    )
    return g.select("group_id", ((F.col("n") == 1) & ~F.col("missing")).alias("linked"))


def remove_common(vectors: DataFrame, key: str) -> DataFrame:
    """(key, vec): subtract the mean and the first principal direction, renormalise."""
    v = vectors.select(key, array_to_vector("vec").alias("features"))
    model = PCA(k=1, inputCol="features", outputCol="pc").fit(v)
    axis = [float(x) for x in model.pc.toArray()[:, 0]]  # one direction, as long as a vector
    mean = vector_to_array(Summarizer.mean(F.col("features")))
    centre = v.agg(mean.alias("m")).withColumn("_one", F.lit(1))
    d = F.array(*[F.lit(x) for x in axis])
    x = vectors.select(key, "vec", F.lit(1).alias("_one")).join(centre, "_one")
    x = x.withColumn("c", F.zip_with("vec", "m", lambda a, b: a - b)).withColumn("d", d)
    proj = F.aggregate(F.zip_with("c", "d", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    x = x.withColumn("p", proj).withColumn("r", F.expr("zip_with(c, d, (a, b) -> a - p * b)"))
    return x.select(key, unit("r").alias("vec"))
