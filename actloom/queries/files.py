"""Sources and sinks: whole tables written to the shared folder, read back and held against the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import corpus_stats
from ..sources import push, readers, sinks
from ..sources.scratch import rename_part, scratch
from ..views import view

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_ACT = ["act_id", "forum_id", "role", "intent", "action", "timestamp"]


@query("k01_records_overwrite", f"SELECT {', '.join(_ACT[:-1])}, timestamp::DOUBLE AS timestamp FROM acts")
def _overwrite(s, d):
    """Written twice; the second time replaces the first."""
    path, acts = scratch(s, "records"), view(s, d, "acts").select(*_ACT)
    for _ in range(2):
        sinks.write_records(acts, path)
    return readers.read_records(s, path, readers.ACTS).select(*_ACT)


@query("k02_records_append", "SELECT role, count(*) AS n FROM acts GROUP BY role")
def _append(s, d):
    path, acts = scratch(s, "records"), view(s, d, "acts").select(*_ACT, "act_index")
    for odd in (0, 1):
        sinks.write_records(acts.filter(F.col("act_index") % 2 == odd), path, append=True)
    return readers.read_records(s, path, readers.ACTS).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("s02_sniffed_document", "SELECT n_nationkey, n_name FROM nation")
def _sniff(s, d):
    """One JSON document over many lines, told from JSON lines by its opening bracket."""
    path = scratch(s, "document")
    rows = F.array_join(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))), ",\n")
    view(s, d, "nation").agg(F.concat(F.lit("[\n"), rows, F.lit("\n]")).alias("value")).write.text(path)
    return readers.sniff_records(s, path, "n_nationkey int, n_name string")


@query("s02_mixed_layouts", "SELECT c_custkey, c_name FROM customer")
def _mixed(s, d):
    """A folder of three layouts: an array over many lines, JSON lines, and one object over many lines."""
    root, rows = scratch(s, "mixed"), view(s, d, "customer").select("c_custkey", "c_name")
    first = rows.agg(F.min("c_custkey").alias("low"))  # one row
    parts = rows.crossJoin(F.broadcast(first))
    lines = parts.filter("c_custkey % 2 = 1 AND c_custkey <> low").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    lines.write.text(f"{root}/lines")
    one = parts.filter("c_custkey = low").select(F.to_json(F.struct("c_custkey", "c_name"), {"pretty": "true"}).alias("value"))
    one.coalesce(1).write.text(f"{root}/object")
    # each task's rows are one array: bracket, rows with commas before all but the first, bracket
    kept = parts.filter("c_custkey % 2 = 0 AND c_custkey <> low").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))

    def framed(batches):
        import pyarrow as pa

        sep = "["
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out += [sep, value]
                sep = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sep == "[" else "]"])], names=["value"])

    kept.mapInArrow(framed, "value string").write.text(f"{root}/array")
    return readers.sniff_records(s, f"{root}/*", "c_custkey long, c_name string")


@query("k03_document", "SELECT count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer")
def _document(s, d):
    report = sinks.document(view(s, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")))
    return s.createDataFrame([(report,)], "doc string").select(F.from_json("doc", "n long, low long, high long").alias("x")).select("x.*")


@query("k04_vectors_resumed", "SELECT vec_id, len(embedding)::INTEGER AS size FROM embeddings")
def _vectors(s, d):
    """A run that stopped after half of the rows goes on without writing them again."""
    path, e = scratch(s, "vectors"), view(s, d, "embeddings").select("vec_id", "embedding")
    sinks.write_vectors(e.filter("vec_id % 2 = 0"), path, "vec_id")
    sinks.write_vectors(e, path, "vec_id")
    return s.read.parquet(path).select("vec_id", F.size("embedding").alias("size"))


@query("k05_contexts", "SELECT n_regionkey::VARCHAR AS ctx, n_nationkey::VARCHAR AS id, n_name AS text FROM nation")
def _contexts(s, d):
    path = scratch(s, "contexts")
    sinks.write_contexts(view(s, d, "nation").select(F.col("n_regionkey").alias("ctx"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text")), path)
    return readers.read_contexts(s, path)


@query("k06_latex", "SELECT c_custkey || ' & ' || c_name || ' & -- ' || chr(92) || chr(92) AS line FROM customer")
def _latex(s, d):
    return sinks.latex_lines(view(s, d, "customer").withColumn("none", F.lit(None).cast("string")), ["c_custkey", "c_name", "none"])


@query("k07_events", "SELECT split_part(thread_id, '#', 1) AS forum_id, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM moves GROUP BY 1")
def _events(s, d):
    """A log of moves and of other events with a status; only the moves are counted."""
    path, moves = scratch(s, "events"), view(s, d, "moves").select("thread_id", "status")
    sinks.log_events(moves, path, "move")
    sinks.log_events(moves, path, "note")
    return corpus_stats.status_counts(s.read.schema("type string, thread_id string, status string, ts long").json(path))


@query("s09_event_files", "SELECT thread_id, count(*) AS n FROM moves GROUP BY thread_id")
def _event_files(s, d):
    """A run's folder for each role, with an events.jsonl in it; other files are passed over."""
    root, moves = scratch(s, "runs"), view(s, d, "moves").select("thread_id", "status", "role")
    for role in ("Author", "Reviewer"):
        made = scratch(s, "made")
        moves.filter(F.col("role") == role).coalesce(1).write.json(made)
        rename_part(s, made, f"{root}/{role}/events.jsonl")
    s.range(5).select(F.lit("x").alias("thread_id")).write.json(f"{root}/other")
    return readers.event_files(s, root, "thread_id string, status string").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))


@query("k08_requirements", "SELECT DISTINCT trim(x) AS name FROM (SELECT unnest(string_split(role, '/')) AS x FROM acts) WHERE trim(x) <> ''")
def _requirements(s, d):
    return sinks.requirements(view(s, d, "acts").select(F.transform(F.split("role", "/"), lambda x: F.trim(x)).alias("needs")), "needs")


@query("k09_publish", "SELECT n_nationkey, n_name FROM nation")
def _publish(s, d):
    """An artifact is staged and moved into the library, where it replaces an older one."""
    library, nation = scratch(s, "library"), view(s, d, "nation").select("n_nationkey", "n_name")
    for rows in (nation.limit(1), nation):
        staged = scratch(s, "staged")
        sinks.write_records(rows, staged)
        path = sinks.publish(s, staged, library, "artifact")
    return readers.read_records(s, path, "n_nationkey int, n_name string")


@query("k10_push_frames", """SELECT 'event: thread' || chr(10) || 'data: {"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' || chr(10) || chr(10) AS frame FROM region""")
def _push(s, d):
    return sinks.push_frames(view(s, d, "region").select("r_regionkey", "r_name"), "thread")


_SPLIT = "CASE CAST(forum_id AS INT) % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'test' ELSE 'none' END"


@query("s18_splits", f"SELECT forum_id, split FROM (SELECT forum_id, {_SPLIT} AS split FROM meta) WHERE split <> 'none'")
def _splits(s, d):
    path = scratch(s, "splits")
    sinks.write_records(view(s, d, "meta").select("forum_id", F.upper(F.expr(_SPLIT)).alias("partition")), path)
    return readers.read_splits(s, path)


@query("s06_resolved_contexts", "SELECT forum_id AS context_id, CASE WHEN conv_id % 3 = 2 THEN 0 ELSE count(*) END::INTEGER AS n FROM turns GROUP BY forum_id, conv_id")
def _resolve(s, d):
    """A third of the threads finds its context in the first source, a third in the second, a third nowhere."""
    t = view(s, d, "turns")
    packed = t.groupBy("forum_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("act_index").cast("int").alias("id"), F.col("action").alias("text")))).alias("segments")).withColumnRenamed("forum_id", "ctx")
    threads = t.select(F.col("forum_id").alias("context_id")).distinct()
    out = readers.resolve_contexts(threads, *[packed.filter(F.col("conv_id") % 3 == i).select("ctx", "segments") for i in (0, 1)])
    return out.select("context_id", F.size("segments").alias("n"))


def _mining(s, d):
    item = F.struct(F.col("act_index").alias("n"), F.col("role"), F.col("action"))
    rows = view(s, d, "turns").groupBy("forum_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return rows.select("forum_id", F.struct(F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["action"].alias("action"))).alias("mining_results")).alias("analysis"))


@query("s20_mining_fallback", "SELECT forum_id || '#' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY act_index) - 1)::VARCHAR, 4, '0') AS act_id, forum_id, role, action FROM turns")
def _fallback(s, d):
    """Acts from the mining records, as their own file is not there."""
    path = scratch(s, "mining")
    sinks.write_records(_mining(s, d), path)
    return readers.acts_or_mining(s, scratch(s, "absent"), path).select("act_id", "forum_id", "role", "action")


@query("s20_acts_first", "SELECT act_id, forum_id, role, action FROM acts")
def _acts_first(s, d):
    path = scratch(s, "acts")
    sinks.write_records(view(s, d, "acts").select("act_id", F.lit("").alias("forum_id"), F.col("forum_id").alias("forum"), "role", "action"), path)
    return readers.acts_or_mining(s, path, scratch(s, "absent")).select("act_id", "forum_id", "role", "action")


@query("s10_page_counts", "SELECT r_name AS ctx, (r_regionkey + 1)::INTEGER AS pages FROM region")
def _pages(s, d):
    """A file with page objects for each region."""
    root = scratch(s, "papers")
    for r in view(s, d, "region").select("r_name", "r_regionkey").collect():
        made = scratch(s, "made")
        s.createDataFrame([("/Type /Pages\n" + "/Type /Page\n" * (r.r_regionkey + 1),)], "value string").coalesce(1).write.text(made)
        rename_part(s, made, f"{root}/{r.r_name}.pdf")
    return readers.page_counts(s, f"{root}/*.pdf").select(F.url_decode("ctx").alias("ctx"), "pages")


@query("s10_compressed_pages", "SELECT n_name AS ctx, (1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey))::INTEGER AS pages FROM nation")
def _compressed_pages(s, d):
    """A file a nation, with a page a customer and one more: a nested page tree inside compressed object streams."""
    root, made = scratch(s, "papers"), scratch(s, "made")
    counts = view(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = view(s, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("pages"))

    @F.pandas_udf("string")
    def pdf(pages):
        return pages.map(_pdf)

    rows.select(F.url_encode("n_name").alias("ctx"), pdf("pages").alias("value")).repartition("ctx").write.partitionBy("ctx").text(made)
    for r in rows.select(F.url_encode("n_name").alias("ctx")).collect():
        rename_part(s, f"{made}/ctx={r.ctx}", f"{root}/{r.ctx}.pdf")
    return readers.page_counts(s, f"{root}/*.pdf").select(F.url_decode("ctx").alias("ctx"), "pages")


def _pdf(pages: int) -> str:
    """A file of so many pages, ten a node of the tree, all objects in one stream, deflated and written in hexadecimal."""
    import zlib

    nodes = [list(range(b, min(b + 10, pages))) for b in range(0, pages, 10)]
    at = {("node", i): 3 + i for i in range(len(nodes))} | {("page", i): 3 + len(nodes) + i for i in range(pages)}
    kids = lambda kind, some: "[" + " ".join(f"{at[kind, i]} 0 R" for i in some) + "]"
    found = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: f"<</Type/Pages/Count {pages}/Kids {kids('node', range(len(nodes)))}>>"}
    found |= {at["node", i]: f"<</Type/Pages/Parent 2 0 R/Count {len(some)}/Kids {kids('page', some)}>>" for i, some in enumerate(nodes)}
    found |= {at["page", p]: f"<</Type /Page /Parent {at['node', p // 10]} 0 R>>" for p in range(pages)}
    heads, body = [], ""
    for number, text in found.items():
        heads.append(f"{number} {len(body)}")
        body += text + " "
    head = " ".join(heads) + " "
    packed = zlib.compress((head + body).encode()).hex() + ">"
    last = 1 + max(found)
    return f"%PDF-1.5\n{last} 0 obj\n<</Type/ObjStm/N {len(found)}/First {len(head)}/Filter[/ASCIIHexDecode/FlateDecode]/Length {len(packed)}>>\nstream\n{packed}\nendstream\nendobj\ntrailer<</Root 1 0 R>>\n%%EOF"


@query("k10_pushed_moves", """SELECT 'move' AS event, thread_id, event_id, status FROM moves""")
def _pushed(s, d):
    """All moves pushed as a stream, then read back from what the epochs name."""
    source, target, check = (scratch(s, n) for n in ("moves", "pushed", "progress"))
    view(s, d, "moves").select("thread_id", "event_id", "status").write.parquet(source)
    push.push(s.readStream.schema(s.read.parquet(source).schema).parquet(source), target, "move", check).awaitTermination()
    return push.pushed(s, target).select("event", F.from_json("data", "thread_id string, event_id long, status string").alias("x")).select("event", "x.*")


_INDEX = """SELECT 'art' || (p_partkey % 400) AS name, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'skill' ELSE 'primitive' END AS kind,
  CASE WHEN p_partkey % 9 > 0 THEN 'code' || p_partkey || '.py' END AS code_path, p_partkey, ['art' || (p_partkey % 7), 'art' || (p_partkey % 1000)] AS needs FROM part"""


@query("s08_library_index", f"""WITH i AS ({_INDEX}), k AS (SELECT name, arg_max(kind, p_partkey) AS kind, arg_max(code_path, p_partkey) AS code_path, arg_max(needs, p_partkey) AS needs FROM i WHERE kind <> '' AND code_path IS NOT NULL GROUP BY name),
  m AS (SELECT name, string_agg(need, ',' ORDER BY need) AS missing FROM (SELECT DISTINCT name, unnest(needs) AS need FROM k) WHERE need NOT IN (SELECT name FROM k) GROUP BY name)
SELECT name, kind, code_path, array_to_string(needs, ',') AS needs, coalesce(missing, '') AS missing FROM k LEFT JOIN m USING (name)""")
def _library_index(s, d):
    """An index of the parts as artifacts, one file in key order, some rows unfit and names taken again: the last one counts."""
    path, key = scratch(s, "library"), F.col("p_partkey")
    name = lambda n: F.concat(F.lit("art"), n.cast("string"))
    size = F.col("p_size") % 5
    kind = F.when(size == 0, F.lit(None)).when(size == 1, F.lit("")).when(size == 2, F.lit("skill")).otherwise(F.lit("primitive"))
    code = F.when(key % 9 > 0, F.concat(F.lit("code"), key.cast("string"), F.lit(".py")))
    rows = view(s, d, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    rows.select(name(key % 400).alias("name"), kind.alias("kind"), code.alias("code_path"), F.array(name(key % 7), name(key % 1000)).alias("needs")).write.json(path)
    found = readers.read_library(s, path, last_wins=True)
    return found.select("name", "kind", "code_path", F.array_join("needs", ",").alias("needs"), F.array_join("missing", ",").alias("missing"))


@query("s17_demo_folders", "SELECT 'paper' || r_regionkey AS ctx, r_name AS text, (r_regionkey % 2)::BIGINT AS images FROM region")
def _demo(s, d):
    """A folder for each region: a markdown file, and an image in every other one."""
    root = scratch(s, "demo")
    for r in view(s, d, "region").select("r_name", "r_regionkey").collect():
        files = [(f"paper{r.r_regionkey}/a.md", r.r_name)] + [(f"paper{r.r_regionkey}/images/f.png", "x")] * (r.r_regionkey % 2)
        for name, text in files:
            made = scratch(s, "made")
            s.createDataFrame([(text,)], "value string").coalesce(1).write.text(made)
            rename_part(s, made, f"{root}/{name}")
    return readers.demo_folders(s, root).select("ctx", F.trim(F.regexp_replace("text", "\n", "")).alias("text"), "images")
