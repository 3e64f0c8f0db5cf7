"""The memory graph: indexing, merging, neighbours and bounded traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, text
from .lineage import kept


def tag_values(prefix: str, tags: str = "tags"):
    """The rest of each tag that starts with ``prefix``."""
    return F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.substr(t, F.lit(len(prefix) + 1)))


# Weights of edges, those of snapshots for upserts and deletes.
MEMORY_DAY, MEMORY_SESSION, SESSION_DAY, CHAT_CODE, DAY_SNAPSHOT, SESSION_SNAPSHOT = 0.62, 0.88, 0.67, 0.74, (0.7, 0.45), (0.79, 0.42)


def clean_ref(ref: Column) -> Column:
    """A reference with forward slashes, trimmed; null where nothing is left."""
    return F.nullif(text.trim(F.regexp_replace(ref, r"\\", "/")), F.lit(""))


def session_ref(rows: DataFrame) -> Column:
    """The transcript that a memory comes from: the source of chat memories, else the first tag that names one."""
    chat = (F.col("sourceType") == "chat") | (F.col("kind") == "chat_turn")
    tagged = F.get(F.filter(F.transform(tag_values("chat-file:"), clean_ref), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.when(chat, clean_ref(F.col("sourceRef"))), tagged)


def file_refs(rows: DataFrame) -> Column:
    """The files of a memory: the source of code, and tags that name files."""
    code = (F.col("kind") == "code_entity") | (F.col("sourceType") == "code")
    return F.array_distinct(F.array_compact(F.concat(F.array(F.when(code, clean_ref(F.col("sourceRef")))), F.transform(tag_values("file:"), clean_ref))))


def node_type(kind: Column) -> Column:
    return F.when(kind == "chat_turn", "chat").when(kind == "code_entity", "function").otherwise("memory")


def edge(a: str, b: str, kind: str, weight: Column, relation: str, branch: str, *scope: Column, operation: Column | None = None) -> Column:
    """An edge as a struct, under an id that its scope makes distinct."""
    ends = [F.col("projectId"), F.lit(branch), F.col(a), F.col(b), F.lit(kind), F.concat_ws(":", *(x.cast("string") for x in scope))]
    done = operation if operation is not None else F.lit(None).cast("string")
    return F.struct(hashing.stable_id("gx_edge", *ends).alias("id"), F.col(a).alias("fromNode"), F.col(b).alias("toNode"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"), F.col("projectId").alias("projectId"), F.lit(relation).alias("relation"), done.alias("operation"))


def exploded(rows: DataFrame, *structs: Column) -> DataFrame:
    """A row for each of the structs that isn't null, from one pass over ``rows``."""
    return rows.select(F.explode(F.array_compact(F.array(*structs))).alias("x")).select("x.*")


def placed(rows: DataFrame, at: Column, branch: str) -> DataFrame:
    """Rows (projectId, logicalId, kind, sourceType, sourceRef, tags, title) with the nodes of the memory, its day and its session."""
    p, b = F.col("projectId"), F.lit(branch)
    made = rows.withColumns({"at": at, "day": F.date_format(F.timestamp_millis(at), "yyyy-MM-dd"), "session": session_ref(rows)})
    return made.withColumns({
        "memoryNode": hashing.stable_id("gx_mem", p, b, F.col("logicalId")), "dayNode": hashing.stable_id("gx_time", p, b, F.col("day")),
        "sessionNode": F.when(F.col("session").isNotNull(), hashing.stable_id("gx_session", p, b, F.col("session"))),
    })


def nodes_of(rows: DataFrame, seen: int) -> DataFrame:
    """Memories, days and sessions; ``seen`` says which of several rows of a node was written last."""
    label = F.coalesce(F.nullif(text.trim(F.col("title")), F.lit("")), F.col("logicalId"))
    named = F.concat(F.lit("Session "), F.coalesce(F.nullif(text.basename(F.col("session")), F.lit("")), F.col("session")))
    kinds = [("memoryNode", node_type(F.col("kind")), label), ("dayNode", F.lit("concept"), F.concat(F.lit("Day "), "day")), ("sessionNode", F.lit("session"), named)]
    return exploded(rows, *(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"), kind.alias("type"), name.alias("label"), "projectId", F.lit(c.removesuffix("Node")).alias("role"), F.lit(seen).alias("seen"), "at")) for c, kind, name in kinds))


def chat_links(rows: DataFrame, branch: str, most: int) -> DataFrame:
    """Chats with the code of the files they name, in order of the files and the latest code first; a chat has at most
    ``most``. A file's code is cut to as many before chats meet it."""
    refs = rows.select("projectId", "logicalId", "kind", "memoryNode", "at", F.posexplode(file_refs(rows)).alias("place", "file"))
    latest = Window.partitionBy("projectId", "file").orderBy(F.desc("at"), "logicalId")
    code = refs.where("kind = 'code_entity'").withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= most).select("projectId", "file", "rank", F.col("memoryNode").alias("code"))
    linked = refs.where("kind = 'chat_turn'").join(code, ["projectId", "file"]).where("memoryNode <> code")
    k = F.row_number().over(Window.partitionBy("memoryNode").orderBy("place", "rank")) - 1
    return linked.withColumn("k", k).where(F.col("k") < most).select(edge("memoryNode", "code", "explains", F.lit(CHAT_CODE), "chat_to_code", branch, F.lit("chat-code"), F.col("file"), F.col("k")).alias("x")).select("x.*")


def index_memories(memories: DataFrame, snapshots: DataFrame | None = None, branch: str = "main", since: int | None = None, most_links: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of memories and of the snapshots of their history, both from ``since`` on.

    Nodes: memories, chat sessions, days. Edges: memory to day and session, session to day, chat to code for
    shared files; day and session to the memory of each snapshot, weaker for deletes. Nodes and edges with one id
    are one: the latest label and type, the greatest weight.
    """
    rows = memories if "logicalId" in memories.columns else memories.withColumn("logicalId", F.col("id"))
    rows = placed(rows, F.coalesce("lastAccessedAt", "createdAt"), branch)
    rows = rows if since is None else rows.where(F.col("at") >= since)
    chat = F.col("session").isNotNull()
    own = exploded(
        rows,
        edge("memoryNode", "dayNode", "derived_from", F.lit(MEMORY_DAY), "memory_time_bucket", branch, F.lit("memory-day"), F.col("at")),
        F.when(chat, edge("memoryNode", "sessionNode", "derived_from", F.lit(MEMORY_SESSION), "memory_session", branch, F.lit("memory-session"), F.col("logicalId"))),
        F.when(chat, edge("sessionNode", "dayNode", "derived_from", F.lit(SESSION_DAY), "session_time_bucket", branch, F.lit("session-day"), F.col("day"))),
    )
    edges = [own, chat_links(rows, branch, most_links)]
    nodes = nodes_of(rows, 0)
    if snapshots is not None:
        s = placed(snapshots.where(F.col("branch") == branch), F.col("validFrom"), branch).where("validFrom > 0")
        s = s if since is None else s.where(F.col("at") >= since)
        s = s.withColumn("title", F.coalesce(F.nullif(text.trim(F.col("title")), F.lit("")), F.concat(F.lit("Memory "), "logicalId")))
        by = lambda w: F.when(F.col("operation") == "delete", w[1]).otherwise(w[0])
        done = F.col("operation")
        edges.append(exploded(
            s,
            edge("dayNode", "memoryNode", "derived_from", by(DAY_SNAPSHOT), "snapshot_event", branch, F.lit("snapshot"), F.col("logicalId"), F.col("validFrom"), done, operation=done),
            F.when(chat, edge("sessionNode", "memoryNode", "derived_from", by(SESSION_SNAPSHOT), "session_snapshot", branch, F.lit("snapshot-session"), F.col("logicalId"), F.col("validFrom"), operation=done)),
        ))
        nodes = nodes.unionByName(nodes_of(s, 1))
    return merge_nodes(nodes), merge_indexed(reduce(DataFrame.unionByName, edges))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """A row per id: the latest label and type, the earliest creation."""
    latest = F.struct("seen", "at", "label")
    return nodes.groupBy("id", "projectId", "role").agg(F.max_by("type", latest).alias("type"), F.max_by("label", latest).alias("label"), F.min("at").alias("createdAt"))


def merge_indexed(edges: DataFrame) -> DataFrame:
    """A row per id with the greatest weight."""
    return edges.groupBy("id", "projectId", "fromNode", "toNode", "type", "relation").agg(F.max("weight").alias("weight"), F.max("operation").alias("operation"))


def index_counts(memories: DataFrame, snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what was scanned and upserted, nodes by role, edges by what they relate."""
    role, relation = F.col("role"), F.col("relation")
    by_role = [F.count_if(role == r).alias(f"{n}Nodes") for r, n in (("memory", "memory"), ("session", "session"), ("day", "temporal"))]
    by_relation = [F.count_if(relation.isin("memory_session", "session_snapshot")).alias("sessionEdges"), F.count_if(relation.isin("memory_time_bucket", "session_time_bucket", "snapshot_event")).alias("temporalEdges"), F.count_if(relation == "chat_to_code").alias("chatToCodeEdges")]
    one = [memories.agg(F.count("*").alias("scannedMemories")), snapshots.agg(F.count("*").alias("scannedSnapshots")), nodes.agg(F.count("*").alias("nodesUpserted"), *by_role), edges.agg(F.count("*").alias("edgesUpserted"), *by_relation)]
    return reduce(DataFrame.crossJoin, one)  # one row each


def upsert_graph(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes or edges after a write: fresh rows win by id, and keep the creation of those they replace."""
    born = stored.select("id", F.col("createdAt").alias("__born"))
    kept = fresh.join(born, "id", "left").withColumn("createdAt", F.coalesce("__born", "createdAt")).drop("__born")
    return stored.join(fresh.select("id"), "id", "left_anti").unionByName(kept, allowMissingColumns=True)


def merge_edges(edges: DataFrame) -> DataFrame:
    """A row per project, ends and type with the greatest weight, under a stable id."""
    merged = edges.groupBy("projectId", "fromNode", "toNode", "type").agg(F.max("weight").alias("weight"))
    return merged.withColumn("id", hashing.stable_id("gx_edge", F.col("projectId"), F.col("fromNode"), F.col("toNode"), F.col("type")))


def neighbors(edges: DataFrame, node: str, limit: int, least: float = 0.0, types: tuple[str, ...] = (), project: str | None = None) -> DataFrame:
    """Edges at a node, in either direction, the heaviest first; two filters instead of an OR."""
    keep = edges.where(F.col("weight") >= least)
    if project:
        keep = keep.where(F.col("projectId") == project)
    if types:
        keep = keep.where(F.col("type").isin(*types))
    out = keep.where(F.col("fromNode") == node).select(F.col("toNode").alias("neighbor"), "type", "weight", F.lit("out").alias("direction"))
    back = keep.where(F.col("toNode") == node).select(F.col("fromNode").alias("neighbor"), "type", "weight", F.lit("in").alias("direction"))
    return out.unionByName(back).orderBy(F.desc("weight"), "neighbor").limit(limit)


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, depth): what ``depth`` outgoing steps reach, at the first step that does."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    front = seen
    for step in range(1, depth + 1):
        new = front.select(F.col("node").alias("fromNode")).join(edges.select("fromNode", "toNode"), "fromNode").select(F.col("toNode").alias("node")).distinct()
        front = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def traverse(edges: DataFrame, start: str, depth: int = 2, most_edges: int = 64, least: float = 0.0) -> DataFrame:
    """(place, fromNode, toNode, type, weight, depth): breadth first over outgoing edges, heaviest first at each
    node, until ``most_edges``. A step keeps at most that many edges, so its ranking is bounded."""
    spark = edges.sparkSession
    e = edges.where(F.col("weight") >= least).select("fromNode", "toNode", "type", "weight")
    front = spark.createDataFrame([(start, 1)], "fromNode string, parentPlace long")
    seen = spark.createDataFrame([(start,)], "node string")
    out: DataFrame | None = None
    count = 0
    for step in range(1, depth + 1):
        order = [F.asc("parentPlace"), F.desc("weight"), F.asc("toNode"), F.asc("type")]
        level = e.join(F.broadcast(front), "fromNode").orderBy(*order).limit(most_edges - count)
        level = level.withColumn("place", F.row_number().over(Window.orderBy(*order)) + count).withColumn("depth", F.lit(step)).drop("parentPlace")
        level = kept(level, "level")  # at most ``most_edges`` rows
        out = level if out is None else out.unionByName(level)
        count += level.count()
        if count >= most_edges:
            break
        front = level.groupBy(F.col("toNode").alias("node")).agg(F.min("place").alias("parentPlace")).join(seen, "node", "left_anti")
        seen = seen.unionByName(front.select("node"))
        front = front.select(F.col("node").alias("fromNode"), F.col("parentPlace").cast("long").alias("parentPlace"))
    return out.select(F.col("place").cast("long").alias("place"), "fromNode", "toNode", "type", "weight", "depth")


def limit_traversal(edges: DataFrame, depth: int = 2) -> DataFrame:
    """The heaviest 12 edges for each step, at least three; ties by their ends."""
    return edges.orderBy(F.desc("weight"), "fromNode", "toNode", "type").limit(max(3, 12 * max(1, depth)))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, projects among both."""
    projects = nodes.select("projectId").unionByName(edges.select("projectId")).agg(F.count_distinct("projectId").alias("projects"))
    return nodes.agg(F.count_distinct("id").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(projects)  # one row each


def remove_node(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes and their incident edges."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "fromNode"), "fromNode", "left_anti").join(gone.withColumnRenamed("id", "toNode"), "toNode", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(edges.columns)
