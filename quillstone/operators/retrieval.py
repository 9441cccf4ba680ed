"""Retrieval of paragraphs under a character budget.

Ranking is relational, and so is the greedy choice of one queue; only that of several
queues, where each pick depends on those before it, runs as a grouped Arrow function. Its
group is the candidates of a few operations that the choice can reach, as numbers: places
and sizes, no text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import stored

DOCUMENT_BUDGET, PROJECT_BUDGET = 12_000, 24_000


def tagged(paragraphs: DataFrame, keywords: Mapping[str, Sequence[str]] = t.KEYWORDS, weights: Mapping[str, int] = t.WEIGHTS, text_col: str = "text", **more: Column) -> DataFrame:
    """Adds low (folded text), hits, tags and score; contents lines have no tags. more:
    other columns to add that are worth making once.

    As a generated row, low and hits are made once a paragraph: of plain columns, a filter
    on the tags would have every text folded and searched again."""
    low = t.folded(F.col(text_col))
    none = F.create_map().cast("map<string,int>")
    hits = F.when(t.is_contents_line(F.col(text_col)), none).otherwise(t.tag_hits(low, keywords))
    made = F.struct(low.alias("low"), hits.alias("hits"), *[c.alias(n) for n, c in more.items()])
    out = paragraphs.select("*", F.inline(F.array(made)))
    return out.withColumn("tags", t.tags(F.col("hits"))).withColumn("score", t.score(F.col("tags"), weights))


def in_document_order(chunks: DataFrame, key: str, budget: int = DOCUMENT_BUDGET) -> DataFrame:
    """Chunks (key, pos, chunk) in order until the first that overflows the budget."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum(F.length("chunk")).over(upto)).filter(F.col("used") <= budget)


def _greedy(sizes: Sequence[int], budget: int) -> list[int]:
    """Places that fit, in order; what doesn't fit is passed over. by_score does this as
    a fold over a queue; this plain form is what tests hold it against."""
    used, out = 0, []
    for i, n in enumerate(sizes):
        if used + n <= budget:
            out.append(i)
            used += n
    return out


#: Parts of a hot group of candidates of one size.
SALTS = 64
#: Groups in which operations are dealt for the choice: a call costs milliseconds, however
#: few candidates it is given.
GROUPS = 1 << 14


def reachable(queue: DataFrame, group: Sequence[str], order: Sequence[Column], salt: Sequence[str], gap: int = 0) -> DataFrame:
    """The candidates of each queue that a greedy choice can come to take: size and
    budget are columns, a candidate costs its size and the gap.

    One that is larger than the budget never fits. Of those of one size, when one is
    passed over, all after it are too, since less is left then; so as many as fit the
    budget alone are all that can be taken. A queue is no longer than a number that the
    budget gives, whatever its operation holds. Large groups are cut down in parts first."""
    cost = F.col("size") + gap
    most = F.when(cost > 0, F.floor(F.col("budget") / cost)).otherwise(F.lit(2**31 - 1))
    out = queue.filter(cost <= F.col("budget")).withColumn("__salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)))
    for more in (["__salt"], []):
        place = Window.partitionBy(*group, "size", *more).orderBy(*order)
        out = out.withColumn("__nth", F.row_number().over(place)).filter(F.col("__nth") <= most)
    return out.drop("__salt", "__nth")


def by_score(chunks: DataFrame, key: str, budget: int = DOCUMENT_BUDGET) -> DataFrame:
    """chunks: key, pos, score, chunk. The best that fit, back in document order; pos is
    a chunk's own number. The choice is made on sizes, chunks are joined after."""
    rows = chunks.select(key, "pos", "score", F.length("chunk").alias("size"), F.lit(budget).alias("budget"))
    few = reachable(rows, [key], [F.desc("score"), F.asc("pos")], ["pos"]).select(key, "pos", "score", "size")

    # The best first: what doesn't fit is passed over.
    queue = F.array_sort(F.collect_list(F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("worse"), "pos", F.col("size").cast("long").alias("size"))))
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(few.dtypes)['pos']}>").alias("places"))
    taken = F.aggregate(
        queue, begin,
        lambda so_far, c: F.when(so_far["used"] + c["size"] <= budget, F.struct((so_far["used"] + c["size"]).alias("used"), F.concat(so_far["places"], F.array(c["pos"])).alias("places"))).otherwise(so_far),
    )
    picked = few.groupBy(key).agg(taken.alias("taken")).select(key, F.explode("taken.places").alias("pos"))
    return chunks.select(key, "pos", "score", "chunk").join(picked, [key, "pos"], "left_semi")


def _queues(candidates: DataFrame) -> tuple[DataFrame, list[Column]]:
    """One row a candidate and tag, and the order in a tag's queue."""
    order = [(~F.array_contains("doc_hints", F.col("tag"))).cast("int"), F.desc(F.coalesce(F.element_at("hits", F.col("tag")), F.lit(1))), (~F.col("numbered")).cast("int"), F.col("doc_idx"), F.col("pos")]
    return candidates.withColumn("tag", F.explode("tags")), order


def ranked_by_tag(candidates: DataFrame, key: str) -> DataFrame:
    """One row a candidate and tag with its rank in the tag's queue.

    candidates: key, doc_idx, pos, tags, hits, doc_hints, numbered."""
    rows, order = _queues(candidates)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "tag").orderBy(*order)))


def round_robin(queues: dict[str, list[int]], sizes: list[int], pinned: Sequence[int], budget: int, order: Sequence[str] = t.TAG_ORDER) -> list[int]:
    """Serve each tag its next candidate that fits, tag by tag and round by round;
    the first pinned candidate is served before. A candidate costs its size and 2
    for the separator; one that doesn't fit when its turn comes is out."""
    chosen: set[int] = set()
    left = budget
    for i in pinned[:1]:
        if sizes[i] + 2 <= left:
            chosen.add(i)
            left -= sizes[i] + 2
    tags = [x for x in order if x in queues] + sorted(x for x in queues if x not in order)
    place = dict.fromkeys(tags, 0)
    while tags:
        going = []
        for tag in tags:
            queue, at = queues[tag], place[tag]
            while at < len(queue) and (queue[at] in chosen or sizes[queue[at]] + 2 > left):
                at += 1
            if at < len(queue):
                chosen.add(queue[at])
                left -= sizes[queue[at]] + 2
                at += 1
                if at < len(queue):
                    going.append(tag)
            place[tag] = at
        tags = going
    return sorted(chosen)


def across_documents(candidates: DataFrame, key: str, budget: str | int = PROJECT_BUDGET) -> DataFrame:
    """The chosen candidates: key, doc_idx, pos, chunk. budget: a number, or the
    name of a column with the operation's own.

    The choice is made on numbers: those candidates that it can reach, with their places
    in the queues and their sizes, are a group; chunks are joined after."""
    own = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    slim = candidates.select(key, "doc_idx", "pos", "tags", "hits", "doc_hints", "numbered", "pinned", F.length("chunk").alias("size"), own.cast("int").alias("budget"))
    rows, order = _queues(slim)
    few = reachable(rows, [key, "tag"], order, ["doc_idx", "pos"], gap=2)
    queued = few.select(key, "doc_idx", "pos", "size", "budget", "tag", F.row_number().over(Window.partitionBy(key, "tag").orderBy(*order)).alias("rank"))
    first = slim.filter("pinned").groupBy(key).agg(F.min(F.struct("doc_idx", "pos", "size", "budget")).alias("p")).select(key, "p.*", F.lit(None).cast("string").alias("tag"), F.lit(0).alias("rank"))
    shape = slim.select(key, "doc_idx", "pos").schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        operations: dict[object, list[tuple]] = {}
        for row in zip(*(pdf[c].tolist() for c in ("doc_idx", "pos", "size", "tag", "rank", "budget", key)), range(len(pdf))):
            operations.setdefault(row[6], []).append(row)
        taken: list[int] = []
        for rows in operations.values():
            rows.sort(key=lambda r: r[4])
            sizes = {r[:2]: (r[2], r[7]) for r in rows}
            places = sorted(sizes)
            number = {place: i for i, place in enumerate(places)}
            queues: dict[str, list[int]] = {}
            for r in rows:
                if isinstance(r[3], str):
                    queues.setdefault(r[3], []).append(number[r[:2]])
            before = [number[r[:2]] for r in rows if not isinstance(r[3], str)]
            chosen = round_robin(queues, [sizes[p][0] for p in places], before, int(rows[0][5]))
            taken += [sizes[places[i]][1] for i in chosen]
        return pdf[[key, "doc_idx", "pos"]].take(taken)

    every = queued.unionByName(first).filter(F.col(key).isNotNull())
    chosen = every.groupBy(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("__group")).applyInPandas(pick, shape)
    return candidates.select(key, "doc_idx", "pos", "chunk").join(chosen, [key, "doc_idx", "pos"], "left_semi")


def candidates_of(paragraphs: DataFrame, key: str, keywords: Mapping[str, Sequence[str]] = t.KEYWORDS) -> DataFrame:
    """paragraphs: key, doc_idx, doc_name, pos, para_id, page, text. The relevant
    ones with all that the choice needs, and their chunks."""
    rows = tagged(paragraphs, keywords, pinned=t.is_summary_page(F.col("text"), t.folded(F.substring("text", 1, t.SUMMARY_HEAD))))
    # Tags are made once: the window below asks for them by every keyword.
    rows = stored(rows.filter((F.size("tags") > 0) | F.col("pinned")), needed=True)
    shown = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("financing")))
    piece = t.chunk(F.col("doc_name"), F.col("para_id"), F.col("page"), t.window(F.col("text"), F.col("low"), shown, keywords))
    return rows.select(key, "doc_idx", "pos", "tags", "hits", t.file_hints(t.folded(F.col("doc_name"))).alias("doc_hints"), "pinned", F.col("para_id").rlike(r"^\d{1,2}\.\d{1,2}$").alias("numbered"), piece.alias("chunk"))


def project_bundle(paragraphs: DataFrame, key: str, notes: DataFrame | None = None, budget: int = PROJECT_BUDGET, keywords: Mapping[str, Sequence[str]] = t.KEYWORDS) -> DataFrame:
    """One excerpt an operation: key, bundle, n_total, n_relevant. notes (key,
    note_idx, note) stand above the excerpt and count against the budget."""
    found = candidates_of(paragraphs, key, keywords)
    totals = paragraphs.groupBy(key).agg(F.count("*").alias("n_total"))
    if notes is None:
        headers = totals.select(key, F.lit("").alias("header"))
    else:
        listed = notes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "note"))), lambda x: x["note"]), "\n").alias("header"))
        headers = totals.select(key).unionByName(listed.select(key)).distinct().join(listed, key, "left").select(key, F.coalesce("header", F.lit("")).alias("header"))
    # Several steps read the candidates; their texts are made once.
    sized = stored(found.join(headers.select(key, (F.lit(budget - 2) - F.length("header")).alias("budget")), key), needed=True)
    relevant = sized.groupBy(key).agg(F.count("*").alias("n_relevant"))
    picked = across_documents(sized, key, "budget")
    body = picked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_idx", "pos", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("body"))
    out = headers.join(totals, key, "left").join(relevant, key, "left").join(body, key, "left")
    parts = F.filter(F.array(F.col("header"), F.coalesce("body", F.lit(""))), lambda p: p != "")
    return out.select(key, F.array_join(parts, "\n\n").alias("bundle"), F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
