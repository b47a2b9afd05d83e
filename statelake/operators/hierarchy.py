"""Full paths, depths, roots and descendants of parent–child rows of any depth.

Tree contraction. Each step removes all leaves (*rake*) and splices out an
independent set of nodes with a single child (*compress*; a node goes
if its random rank of this step is above those of its parent and that child). Removed nodes are
recorded with the edge they had. Bushy parts vanish by raking, long chains
shrink geometrically by compressing, so a tree of any shape is gone after a
number of steps that is logarithmic in its size. A loop cannot be raked away:
compression shrinks it until one node is its own parent, which exposes it
together with the smallest id that was spliced into it.

The recorded contractions are then reversed. The parent of a removed node
outlived it, so records form trees that are no deeper than there were steps. A
record joined with that of its parent spans the steps of both; after a number
of such joins that is logarithmic in the number of steps, every record leads to
a root or a loop. No step's result is read again by a later one.

``STEPS`` steps make up one job and one table in the shared scratch area;
nothing is collected. The driver only learns, with each table, how many edges
are left.

Edge cases: the newest row of a node counts, ties by the greater parent and
name; null, empty and unknown parents make roots; a node that is its own parent
is a loop of one; null ids are dropped; null names are ``''``; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from statelake.session import Scratch

STEPS = 2
MAX_ROUNDS = 200

_SEG = "array<struct<id: string, name: string>>"


def newest_nodes(folders: DataFrame) -> DataFrame:
    """``id, parent, name``, one row per id; ``parent`` is null for roots."""
    rows = folders.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "parent", "fileName")).alias("r"))
    nodes = rows.select("id", F.nullif(F.col("r.parent"), F.lit("")).alias("parent"), F.coalesce("r.fileName", F.lit("")).alias("name"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    # roots look for a name of their own, so that they do not all meet in one task
    up = F.coalesce("parent", F.concat(F.lit("\0"), "id"))
    return nodes.join(known, up == F.col("up"), "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "name")


# One rake and one compress; {k} is the step's number. ``gone`` marks removed nodes, those of earlier steps as well, which pass unchanged.
# A node that is its own parent is what is left of a loop: it becomes the root of all that hangs below. A leaf below a spliced
# node moves up with it, so that its recorded parent outlives this step. Ranks take the number as text, which stays out of the
# generated code: it is compiled once for all steps. Roots have no parent to look for; a name of their own spreads them over tasks.
_STEP = """
    WITH nodes AS (
        SELECT id, IF(round, NULL, parent) AS parent, seg, lo, IF(round, least(id, lo), loop) AS loop, gone, NOT gone AND NOT round AND parent IS NOT NULL AS hangs
        FROM (SELECT *, NOT gone AND coalesce(id = parent, false) AS round FROM {active})),
    kids AS (SELECT parent AS id, count(*) AS kids, min(id) AS child FROM nodes WHERE hangs GROUP BY parent),
    marked AS (
        SELECT n.*, hangs AND kids IS NULL AS leaf,
               coalesce(hangs AND kids = 1 AND xxhash64(n.id, '{k}') > xxhash64(parent, '{k}') AND xxhash64(n.id, '{k}') > xxhash64(child, '{k}'), false) AS splice
        FROM nodes n LEFT JOIN kids k ON n.id = k.id),
    spliced AS (SELECT id AS via, parent AS up, seg AS up_seg, lo AS up_lo FROM marked WHERE splice),
    moved AS (SELECT m.*, up, up_seg, up_lo, up IS NOT NULL AND hangs AND NOT splice AS lift FROM marked m LEFT JOIN spliced ON coalesce(parent, concat('\\0', id)) = via)
    SELECT id, IF(lift, up, parent) AS parent, IF(lift, concat(up_seg, seg), seg) AS seg, IF(lift, least(lo, up_lo, parent), lo) AS lo, loop, gone OR leaf OR splice AS gone
    FROM moved"""


def _step(active: DataFrame, number: int) -> DataFrame:
    return active.sparkSession.sql(_STEP.replace("{k}", str(number)), active=active)


def contract(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame], int]:
    """What is left (roots; ``loop`` names the loop that one stands for), the records of removed nodes in order, and the number of steps."""
    no = F.lit(None).cast("string")
    active = nodes.select("id", "parent", F.array(F.struct("id", "name")).cast(_SEG).alias("seg"), no.alias("lo"), no.alias("loop"), F.lit(False).alias("gone"))
    tables: list[DataFrame] = []
    for number in range(MAX_ROUNDS):
        rows = active
        for step in range(STEPS if number else 0):  # the first table holds the nodes themselves
            rows = _step(rows, number * STEPS + step)
        seen = Observation()
        edges = F.count(F.when(F.col("parent").isNotNull() & ~F.col("gone"), 1)).alias("edges")
        after = scratch.stage(rows.observe(seen, edges), f"round{number}", ["gone"])
        tables.append(after)
        active = after.where("not gone")
        if not seen.get["edges"]:
            return active, [t.where("gone") for t in tables[1:]], number * STEPS
    raise RuntimeError(f"the hierarchy has not contracted within {MAX_ROUNDS * STEPS} steps")


def resolve(nodes: DataFrame) -> DataFrame:
    """``id, root_id, depth, path`` (array of id and name from the root down), ``loop`` (smallest id on the loop, null if there is none)."""
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    left, records, steps = contract(nodes, scratch)
    known = [left.select("id", "seg", "loop")]
    open_ = reduce(DataFrame.unionByName, records).select("id", "parent", "seg") if records else None
    spans = 1
    while open_ is not None and spans <= steps:  # a record leads over `spans` steps, and at most `steps` lie above it
        done = reduce(DataFrame.unionByName, known).withColumn("up", F.lit(None).cast("string"))
        above = done.unionByName(open_.select("id", "seg", F.lit(None).cast("string").alias("loop"), F.col("parent").alias("up")))
        above = above.select(F.col("id").alias("parent"), F.col("seg").alias("up_seg"), "loop", "up")
        joined = open_.join(above, "parent").select("id", F.col("up").alias("parent"), F.concat("up_seg", "seg").alias("seg"), "loop", F.col("up").isNull().alias("known"))
        after = scratch.stage(joined, f"span{spans}", ["known"])
        known.append(after.where("known").select("id", "seg", "loop"))
        open_ = after.where("not known").select("id", "parent", "seg")
        spans *= 2
    on_loop = F.col("loop").isNotNull()
    return reduce(DataFrame.unionByName, known).select(
        "id",
        F.coalesce("loop", F.col("seg")[0]["id"]).alias("root_id"),
        F.when(on_loop, -1).otherwise(F.size("seg") - 1).cast("long").alias("depth"),
        F.col("seg").alias("path"),
        "loop",
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """``id, descendant, distance`` for every node above another; loops have none."""
    clear = resolved.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return clear.where(F.col("at") < F.col("depth")).select(F.col("node.id").alias("id"), "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """``id, descendants``: the number of nodes below each node, by an aggregate with map-side combine."""
    return resolved.where("depth > 0").select(F.explode(F.slice("path", 1, F.col("depth").cast("int"))).alias("node")).groupBy(F.col("node.id").alias("id")).agg(F.count(F.lit(1)).alias("descendants"))


def path_text(path: str = "path"):
    return F.array_join(F.transform(F.col(path), lambda n: n["name"]), "/")


def place_files(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """``id, root_id, depth, directory, name, folder_id`` of each file by the folder named in its key; a file without one is its own root.

    Keys: ``\\`` separates like ``/``; empty and ``.`` segments mean nothing; the last segment is the file's name. Of several
    folders with one path the one with the smallest root counts, then the least deep, then the one with the smallest id.
    """
    newest = files.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "key")).alias("r"))
    steps = F.filter(F.split(F.translate(F.coalesce("r.key", F.lit("")), "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    directory = F.when(F.size("steps") > 1, F.array_join(F.slice("steps", 1, F.size("steps") - 1), "/"))
    keyed = newest.select("id", steps.alias("steps")).select("id", directory.alias("directory"), F.coalesce(F.try_element_at("steps", F.lit(-1)), F.lit("")).alias("name"))
    places = resolved.where("depth >= 0").groupBy(path_text().alias("directory")).agg(F.min(F.struct("root_id", "depth", "id")).alias("at"))
    joined = keyed.join(places, "directory", "left")
    return joined.select(
        "id", F.coalesce("at.root_id", "id").alias("root_id"), F.coalesce(F.col("at.depth") + 1, F.lit(0)).cast("long").alias("depth"), "directory", "name", F.col("at.id").alias("folder_id")
    )


def hierarchy_of(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``id, root_id, depth`` of every folder and file. An id of both tables counts as a folder."""
    resolved = resolve(newest_nodes(folders))
    placed = place_files(files, resolved).join(resolved.select("id"), "id", "left_anti")
    return resolved.select("id", "root_id", "depth").unionByName(placed.select("id", "root_id", "depth"))


def tree_with_files(folders: DataFrame, files: DataFrame) -> DataFrame:
    """What :func:`resolve` gives, with a row per file as well: its folder's path and then its own name. An id of both tables counts as a folder."""
    resolved = resolve(newest_nodes(folders))
    placed = place_files(files, resolved).join(resolved.select("id"), "id", "left_anti")
    above = resolved.select(F.col("id").alias("folder_id"), F.col("path").alias("up"))
    own = F.array(F.struct("id", "name")).cast(_SEG)
    hung = placed.join(above, "folder_id", "left").select(
        "id", "root_id", "depth", F.concat(F.coalesce("up", F.array().cast(_SEG)), own).alias("path"), F.lit(None).cast("string").alias("loop")
    )
    return resolved.unionByName(hung)
