"""C1 where levels are thin: many of them in one job.

Pages that lead on one by one (next links, pages behind refused ones) make levels of a few
pages each, thousands of them, and a job a level takes hours for little work. Here a job takes
what lies around the URLs of a level and walks it, seed by seed, in the order of the queue.

What may be saved at all does not change during a crawl, so it is written once more in the
order of the URLs and numbered, with links as numbers: a block holds the pages whose numbers
have the same leading bits, and sites number what belongs together side by side. The walk of a
seed gets the blocks its URLs lie in and those next to them, without what it has saved or whose
text it knows. It ends
before the first level that needs another block; that level is where the next job begins. How
large blocks are follows from the room that all seeds together may take, so the memory of a
task has a bound. Where links lead to blocks at random a job does one level, as without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import observed, written

ROOM = 1 << 21  # pages and links that the blocks of one job hold, about
SMALLEST = 6  # bits of the least block that is worth a job
ENDLESS = 1 << 30

_WALKED = "seed_id bigint, number bigint, step int, place bigint"


def numbered_index(allowed: DataFrame, folder: str) -> tuple[DataFrame, float]:
    """The rows of a link index in the order of their URLs, with ``number`` and ``linked``, the
    ``number, url`` of those targets that are rows too. Also how many links a row has."""
    ranged = allowed.repartitionByRange("url").sortWithinPartitions("url")
    rows = written(ranged.withColumn("number", F.monotonically_increasing_id()), f"{folder}/rows")
    edges = rows.select(F.col("number").alias("source"), F.posexplode("targets").alias("pos", "url"))
    met = edges.join(rows.select("url", "number"), "url")
    linked = F.array_sort(F.collect_list(F.struct("pos", "number", "url")))
    linked = F.transform(linked, lambda t: F.struct(t["number"].alias("number"), t["url"].alias("url")))
    lists = met.groupBy("source").agg(linked.alias("linked")).withColumnRenamed("source", "number")
    whole = rows.join(lists, "number", "left").repartitionByRange("number").sortWithinPartitions("number")
    told = {"rows": F.count(F.lit(1)), "links": F.sum(F.coalesce(F.size("linked"), F.lit(0)))}
    whole, told = observed(whole, f"{folder}/index", **told)
    return whole, (told["links"] or 0) / max(told["rows"], 1)


def _walker(shift: int, most: int):
    """Walks a seed's blocks level by level. Gives what is saved, by step and place in it, and
    a row without number that tells how many steps were whole."""

    def walk(key: tuple, entry, rows):
        import pandas as pd

        if not len(entry):
            return pd.DataFrame([], columns=["seed_id", "number", "step", "place"])
        texts_of = dict(zip(rows["number"], rows["sha1"]))
        links_of = dict(zip(rows["number"], rows["linked"]))
        room = int(entry["room"].iloc[0])  # pages the seed may still save
        known = {(n >> shift) + side for n in entry["number"] for side in (-1, 0, 1)}
        first = sorted(zip((list(o) for o in entry["ord"]), entry["number"]))
        level, out, saved, texts, step = [n for _, n in first], [], set(), set(), 0
        while step < most and level and room and all(n >> shift in known for n in level):
            new, blank = [], False
            for n in level:
                if not room or n in saved or n not in texts_of:
                    continue
                text = texts_of[n]
                if text is None:  # unknown texts are compared within their level only
                    if blank:
                        continue
                    blank = True
                elif text in texts:
                    continue
                texts.add(text)
                saved.add(n)
                new.append(n)
                room -= 1
            out += [(key[0], n, step, place) for place, n in enumerate(new)]
            level = list(dict.fromkeys(int(t) for n in new if links_of[n] is not None for t in links_of[n]))
            step += 1
        out.append((key[0], None, step if level and room else most, None))
        found = pd.DataFrame(out, columns=["seed_id", "number", "step", "place"])
        return found.astype({"number": "Int64", "place": "Int64"})

    return walk


def walk_stretch(
    frontier: DataFrame,
    seen: DataFrame,
    index: DataFrame,
    links: float,
    folder: str,
    most: int = ENDLESS,
    max_pages: int | None = None,
) -> tuple[DataFrame, int] | None:
    """Rows that the next levels save, with ``step``, the number of their level from 0, and how
    many levels that is; ``most`` if there are no others. All seeds do the same number of
    levels. None if the URLs of the frontier are too many for blocks, or seeds share an id."""
    asked = frontier.groupBy("seed_id", "url").agg(F.min(F.struct("ord", "seed", "base")).alias("_first"))
    asked = asked.select("seed_id", "url", "_first.*").join(index.select("url", "number"), "url").drop("url")
    if max_pages is None:
        asked = asked.withColumn("room", F.lit(ENDLESS).cast("bigint"))
    else:
        used = seen.groupBy("seed_id").agg(F.count("*").alias("_used"))
        left = F.greatest(max_pages - F.coalesce("_used", F.lit(0)), F.lit(0)).cast("bigint")
        asked = asked.join(used, "seed_id", "left").withColumn("room", left).drop("_used")
    entry, told = observed(
        asked, f"{folder}/entry", rows=F.count(F.lit(1)), first=F.min("number"), last=F.max("number")
    )
    shift = max(1, int(ROOM / (1 + links) / max(told["rows"], 1) / 3)).bit_length() - 1
    named = entry.select("seed_id", "seed", "base").distinct()
    if shift < SMALLEST or not named.groupBy("seed_id").count().filter("count > 1 OR seed_id IS NULL").isEmpty():
        return None
    block = F.shiftright("number", shift)
    beside = F.explode(F.array(block - 1, block, block + 1)).alias("_block")
    blocks = entry.select("seed_id", "base", beside).distinct()
    near = index
    if told["rows"]:
        lo, hi = ((told["first"] >> shift) - 1) << shift, ((told["last"] >> shift) + 2) << shift
        near = index.filter((F.col("number") >= lo) & (F.col("number") < hi))
    base = F.col("base")
    scoped = F.filter("linked", lambda t: t["url"].startswith(base))
    around = near.select("number", "url", "sha1", "linked", block.alias("_block")).join(blocks, "_block").filter(
        F.col("url").startswith(base)
    )
    around = around.join(seen.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
    around = around.join(seen.select("seed_id", "sha1"), ["seed_id", "sha1"], "left_anti")
    linked = F.transform(scoped, lambda t: t["number"]).alias("linked")
    around = around.select(F.col("seed_id").alias("_seed"), "number", "sha1", linked).groupBy("_seed")
    entries = entry.select("seed_id", "number", "ord", "room").groupBy("seed_id")
    walked = entries.cogroup(around).applyInPandas(_walker(shift, most), _WALKED)
    walked, ends = observed(
        walked, f"{folder}/walked", steps=F.min(F.when(F.col("number").isNull(), F.col("step")))
    )
    steps = most if ends["steps"] is None else ends["steps"]
    kept = walked.filter(F.col("number").isNotNull() & (F.col("step") < steps)).join(named, "seed_id")
    rows = kept.join(index.select("number", "url", "sha1", "page_id", "error", "targets"), "number").select(
        "seed_id", "sha1", F.array("place").alias("ord"), "seed", "base", "url", "page_id", "error",
        F.filter("targets", lambda t: t.startswith(base)).alias("targets"), "step",
    )
    return rows, steps
