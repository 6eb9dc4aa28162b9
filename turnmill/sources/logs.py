"""Reading and writing of logs, transcripts, registries and snapshots (S)."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as T
from . import growing

#: Typed columns of each kind of record; payloads stay JSON text.
KINDS = {
    "turn": "turn_id string, session_id string, source string, host string, started_at long, ended_at long, tier string, model string, outcome string, prompt_tokens long, completion_tokens long, wall_ms long",
    "event": "turn_id string, ts long, kind string, name string, duration_ms long, ok int, payload string",
    "text": "turn_id string, kind string, seq long, body string, expires_at long",
    "judgment": "turn_id string, judge_model string, verdict string, rubric string, notes string, lesson string, created_at long",
    "decision": "turn_id string, domain string, chosen string, alternatives string, features string, shadow int, weights_version string, explored int, reason string, epsilon double",
    "probe": "host string, kind string, ts long, ok long, total long, detail string",
    "tuning_change": "change_id string, applied_at long, domain string, path string, summary string, evidence string",
    "host_metrics": "host string, ts string, cpu_pct double, mem_used_mb long",
    "scope_record": "record_id string, session_id string, created_at long, tier string, verdict string",
}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """S-1: kind, line, file and position of every line that is JSON with a _kind; a torn line costs only itself."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.filter(F.trim("value") != "").withColumn("kind", F.when(F.try_parse_json("value").isNotNull(), F.get_json_object("value", "$._kind")))


def rejected(log: DataFrame) -> DataFrame:
    return log.filter("kind is null")


def split_kinds(log: DataFrame) -> dict[str, DataFrame]:
    """S-2: a typed frame for each kind."""
    return {k: log.filter(F.col("kind") == k).select(F.from_json("value", s).alias("x"), "file").select("x.*", "file") for k, s in KINDS.items()}


def kind_counts(log: DataFrame) -> DataFrame:
    """S-2: unknown kinds are counted too."""
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def write_log(df: DataFrame, path: str, ts: str) -> None:
    """S-4: appends JSON by UTC day of a time in ms."""
    # a day's rows go together, so that each append adds few files; Spark splits a day of very many
    days = df.withColumn("day", F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd")).hint("rebalance", F.col("day"))
    days.write.partitionBy("day").mode("append").json(path)


def read_transcripts(spark: SparkSession, root: str, chunk: int = growing.CHUNK) -> DataFrame:
    """S-5: session (the file's stem; for nested files the parent's), nested, line number, row as text, bad (no JSON). A file is read in ranges of chunk bytes, its lines numbered by prefix sums, or, if it is packed (.gz, .bz2), as a stream; where root is a file or a pattern, or a folder that only Spark's readers can open, a file is one row. root means what it means to Spark's readers; a folder that isn't there has no rows."""
    try:
        if re.search(r"[*?\[{]", root):
            raise NotADirectoryError(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()  # with the session's file system, and from its working folder
        fs, at, _ = growing.opened(full)
        if fs.get_file_info(at).is_file:
            raise NotADirectoryError(root)
        lines = growing.numbered(spark, full, chunk).withColumnRenamed("value", "row")
    except (NotADirectoryError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
        lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("line", "row")).withColumn("line", F.col("line").cast("long"))
    nested = F.col("file").contains("/subagents/")
    stem = F.regexp_extract(F.substring_index("file", "/", -1), r"^([^/]+?)(?:\.[^./]*)?(?:\.(?:gz|bz2))?$", 1)  # of the name, since the search begins anew at each letter of a path
    session = F.when(nested, F.regexp_extract("file", r"([^/]+)/subagents/[^/]+$", 1)).otherwise(stem)
    rows = lines.select(session.alias("session"), nested.alias("nested"), "file", "line", "row")
    return rows.filter(F.trim("row") != "").withColumn("bad", F.try_parse_json("row").isNull())


#: What is read of a transcript's row; content may be a string or an array of blocks.
ROW = "type string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, promptSource string, timestamp string, cwd string, gitBranch string, version string, isApiErrorMessage boolean, error string, message struct<id: string, role: string, model: string, usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long>, content: string>"
BLOCKS = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def transcript_rows(transcripts: DataFrame) -> DataFrame:
    """N-2: typed rows with blocks (null where the content is a plain string) and plain."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # a filter on what is parsed isn't pushed below it, to parse anew for each of its terms
    rows = transcripts.filter("not bad").select("session", "nested", "line", once(F.from_json("row", ROW)).alias("x")).select("session", "nested", "line", "x.*")
    array = F.col("message.content").startswith("[")
    return rows.select("*", once(F.when(array, F.from_json("message.content", BLOCKS))).alias("blocks"), F.when(~array, F.col("message.content")).alias("plain"))


#: Prompts that a person typed, and texts that say nothing.
TYPED = ["typed", "queued", "suggestion_accepted"]
NOISE = ["[Request interrupted by user]", "[Request interrupted by user for tool use]", "continue", "Continue", "API Error: Request was aborted."]


def human_prompts(rows: DataFrame) -> DataFrame:
    """C-5 and C-6: session, line, text of what a person wrote, without what a harness wraps around it; a row with a tool's result, or with nothing left, isn't one."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    typed = (F.col("type") == "user") & no("isSidechain") & no("isMeta") & no("isCompactSummary") & (F.col("promptSource").isNull() | F.col("promptSource").isin(TYPED)) & (F.col("message.role") == "user")
    joined = F.when(~F.exists("blocks", lambda b: b["type"] == "tool_result"), F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))
    text = T.clean_text(F.coalesce("plain", joined))
    out = rows.filter(typed).select("session", "line", text.alias("text"))
    return out.filter(F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").isin(NOISE) & ~F.col("text").startswith("[Request interrupted"))


#: The tools that edit files.
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]


def tool_uses(rows: DataFrame) -> DataFrame:
    """N-2: each call: session_id, line, message_id, tool_use_id, name, input (JSON), how many calls its row holds, whether it is a side chain's, and `issue`, what its row lacks. A call without an id can't be traced, its message gets a name of its own if it has none."""
    calls = F.filter("blocks", lambda b: b["type"] == "tool_use")
    uses = rows.withColumn("__u", calls).filter(F.size("__u") > 0)
    message = F.coalesce(F.nullif(F.col("message.id"), F.lit("")), F.concat(F.lit("__unknown_"), F.col("line")))
    ms = scalars.iso_to_ms(F.col("timestamp"))
    out = uses.select("session", "line", message.alias("message_id"), F.coalesce(ms, F.lit(0)).alias("ts"), F.coalesce("isSidechain", F.lit(False)).alias("sidechain"), F.size("__u").cast("long").alias("row_batch_size"), F.explode("__u").alias("b"))
    return out.select(
        F.col("session").alias("session_id"), "line", "message_id", "ts", F.col("b.id").alias("tool_use_id"), F.coalesce(F.nullif(F.col("b.name"), F.lit("")), F.lit("<unknown>")).alias("name"), F.coalesce("b.input", F.lit("{}")).alias("input"), "row_batch_size", "sidechain",
        F.when(F.coalesce("b.id", F.lit("")) == "", "tool_use block missing id").alias("issue"),
    )


def tool_results(rows: DataFrame) -> DataFrame:
    """N-2: each result: session_id, line, tool_use_id, is_error, result (plain text, or its text blocks by lines)."""
    found = rows.select("session", "line", F.explode("blocks").alias("b")).filter("b.type = 'tool_result'")
    parts = F.from_json("b.content", "array<struct<text: string>>")
    said = F.when(F.trim("b.content").startswith("["), F.array_join(F.transform(parts, lambda x: x["text"]), "\n"))
    return found.select(F.col("session").alias("session_id"), "line", "b.tool_use_id", F.coalesce("b.is_error", F.lit(False)).cast("int").alias("is_error"), F.coalesce(said, "b.content", F.lit("")).alias("result"))


def file_edits(rows: DataFrame) -> DataFrame:
    """A-12: session, nested, ts (ISO text), path of each call that edits a file."""
    uses = rows.filter("message.role = 'assistant'").filter(F.col("nested") | ~F.coalesce("isSidechain", F.lit(False)))
    calls = uses.select("session", "nested", F.coalesce("timestamp", F.lit("")).alias("ts"), F.explode("blocks").alias("b")).filter(F.col("b.type").eqNullSafe("tool_use") & F.col("b.name").isin(EDIT_TOOLS))
    at = lambda k: F.nullif(F.get_json_object("b.input", f"$.{k}"), F.lit(""))
    return calls.select("session", "nested", "ts", F.coalesce(at("file_path"), at("notebook_path")).alias("path")).filter("path is not null")


#: What a harness writes where a person interrupts.
INTERRUPTS = ["[Request interrupted by user]", "[Request interrupted by user for tool use]"]


def usage_evidence(rows: DataFrame) -> DataFrame:
    """A-18: session_id, line, ts, api_error, error, interrupted of rows that show how a turn ended."""
    texts = F.coalesce(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), F.array(F.col("plain")))
    hit = (F.col("type") == "user") & F.exists(texts, lambda t: F.trim(t).isin(INTERRUPTS))
    out = rows.select(F.col("session").alias("session_id"), "line", scalars.iso_to_ms(F.col("timestamp")).alias("ts"), F.coalesce("isApiErrorMessage", F.lit(False)).alias("api_error"), "error", F.coalesce(hit, F.lit(False)).alias("interrupted"))
    return out.filter("ts is not null and (api_error or interrupted)")


def read_gate_log(spark: SparkSession, path: str) -> DataFrame:
    """S-6: the gate's decisions, a JSON object a line; a torn line costs only itself. A row without a tier was suppressed."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.trim("value") != "")
    shape = "ts string, session_id string, cwd string, tier string, suppressed boolean, reasons array<string>, has_active_scope boolean, prompt_sha1 string, prompt_len long"
    return lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", shape).alias("x")).select("x.*")


#: Folders that the driver lists, a level at a time, until it has so many; tasks list what is below.
FOLDERS = 256
#: Bytes of files that a task hands on at once.
HELD = 4 << 20


def small_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, content, length of each file below root whose name fits, hidden ones left out, as Spark's binaryFile has them, and empty files, which it leaves out. Files are found and read by tasks, many by each: Spark's reader lists them on the driver and counts 4 MB for opening each, a task for 32. Where root is a file or a pattern, or only Spark's readers can open it, they read it."""
    lead = None
    try:
        if not re.search(r"[*?\[{]", root):
            at = spark._jvm.org.apache.hadoop.fs.Path(root)
            full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
            fs, top, lead = growing.opened(full)
            lead = lead if fs.get_file_info(top).type == pfs.FileType.Directory else None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass
    if lead is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content", "length")
    growing.registered(spark)  # workers need not have this package
    shown = lambda f: not f.base_name.startswith((".", "_"))
    fits = lambda f: f.is_file and fnmatch.fnmatchcase(f.base_name, pattern)
    files, folders = [], [top]
    while folders and len(folders) < FOLDERS:
        found = [f for folder in folders for f in fs.get_file_info(pfs.FileSelector(folder)) if shown(f)]
        files += [f.path for f in found if fits(f)]
        folders = [f.path for f in found if f.type == pfs.FileType.Directory]

    def listed(batches):
        own = growing.opened(full)[0]
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                left = [folder]
                while left:
                    found = [f for f in own.get_file_info(pfs.FileSelector(left.pop())) if shown(f)]
                    left += [f.path for f in found if f.type == pfs.FileType.Directory]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([f.path for f in found if fits(f)], pa.string())})

    def read(batches):
        own = growing.opened(full)[0]
        shape = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64())])
        for batch in batches:
            paths, held, size = [], [], 0
            for path in batch["path"].to_pylist():
                with own.open_input_file(path) as handle:
                    held.append(handle.read())
                paths.append(lead + path)
                size += len(held[-1])
                if size >= HELD:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": held, "length": [len(x) for x in held]}, shape)
                    paths, held, size = [], [], 0
            yield pa.RecordBatch.from_pydict({"path": paths, "content": held, "length": [len(x) for x in held]}, shape)

    names = spark.createDataFrame([(f,) for f in files], "path string")
    if folders:
        below = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), FOLDERS))
        names = names.unionByName(below.mapInArrow(listed, "path string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(n, "path").mapInArrow(read, "path string, content binary, length long")


WIKILINK = re.compile(r"\[\[([^\]|#]+)")
#: What S-8 says of each document.
INDEXED = "path string, project string, sha string, outcome string, name string, description string, kind string, triggers string, links array<string>"


def _front(text: str) -> dict | str:
    """A front matter's keys, or what is wrong with it. A key has a value, a folded or literal block, or keys of its own, further in."""
    lines = text.splitlines()
    closed = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if not lines or lines[0].strip() != "---" or closed is None:
        return "no_frontmatter"
    out: dict = {}
    bare = lambda v: v[1:-1] if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'" else v
    key, style, held = None, "", []

    def done() -> None:
        if key is None:
            return
        if style == ">":
            out[key] = " ".join(filter(None, (x.strip() for x in held)))
        elif style == "|":
            out[key] = "\n".join(x[2:] for x in held)
        else:
            own = {k.strip(): bare(v.strip()) for k, c, v in (x.strip().partition(":") for x in held) if c}
            out[key] = own or None

    for line in lines[1:closed]:
        inner = line.startswith(" ") or style in (">", "|") and not line.strip()
        if key is not None and inner:
            held.append(line)
            continue
        if not line.strip() or line.strip().startswith("#") or line.startswith(" "):
            continue
        if ":" not in line:
            return "malformed"
        done()
        key, held = None, []
        name, _, value = line.partition(":")
        if value.strip() in (">", "|", ""):
            key, style = name.strip(), value.strip()
        else:
            out[name.strip()], style = bare(value.strip()), ""
    done()
    return out


def _indexed(parts):
    import hashlib

    import pandas as pd

    for part in parts:
        out = []
        for path, raw in zip(part["path"], part["content"]):
            project = path.rsplit("/", 3)[-3] if path.count("/") >= 3 else ""
            row = dict.fromkeys(("name", "description", "kind", "triggers", "links")) | {"path": path, "project": project, "sha": hashlib.sha256(raw).hexdigest()}
            try:
                text = raw.decode()
                found = _front(text)
            except UnicodeDecodeError:
                found = "unreadable"
            if isinstance(found, str):
                row["outcome"] = found
            elif not found.get("name"):
                row["outcome"] = "missing_name"
            else:
                meta, body = found.get("metadata"), text.split("---", 2)[-1]
                said = [t for t in (m.strip() for m in WIKILINK.findall(body)) if t]
                row |= {"name": found["name"], "description": found.get("description") or None, "kind": meta.get("type") if isinstance(meta, dict) else None, "triggers": found.get("trigger") or found.get("triggers") or None, "links": list(dict.fromkeys(said)), "outcome": "read"}
                row["triggers"] = row["triggers"] if isinstance(row["triggers"], str) else None
            out.append(row)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INDEXED.split(", ")])


def scan_markdown_index(spark: SparkSession, root: str, held: DataFrame | None = None) -> DataFrame:
    """S-8: path, project, sha, outcome, name, description, kind, triggers, links of each markdown document below root (project/folder/name.md; MEMORY.md is an index, not one of them).

    outcome: unreadable, no_frontmatter, malformed, missing_name, unchanged (held has the same sha for its project and name), else written. A document without a description counts as written; missing_description() counts it too.
    Front matter nests and folds, so documents, whole but small, are parsed in batches of Python."""
    files = small_files(spark, root, "*.md").select("path", "content")
    docs = files.filter(~F.col("path").endswith("/MEMORY.md")).mapInPandas(_indexed, INDEXED)
    if held is None:
        return docs.withColumn("outcome", F.when(F.col("outcome") == "read", "written").otherwise(F.col("outcome")))
    known = held.select("project", "name", F.col("content_sha").alias("__sha"))
    state = F.when(F.col("__sha").eqNullSafe(F.col("sha")), "unchanged").otherwise("written")
    return docs.join(known, ["project", "name"], "left").withColumn("outcome", F.when(F.col("outcome") == "read", state).otherwise(F.col("outcome"))).select(docs.columns)


def index_counts(docs: DataFrame) -> DataFrame:
    """S-8: documents by outcome, and those without a description."""
    lacks = F.col("name").isNotNull() & F.col("description").isNull()
    return docs.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(lacks).alias("missing_description"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """S-7."""
    return spark.read.option("multiLine", "true").json(path).withColumn("label", F.col("label").cast("int")).withColumn("regex", F.col("regex").cast("int"))


def read_host_stores(spark: SparkSession, hosts: dict[str, str], expected: list[str]) -> tuple[DataFrame | None, list[str]]:
    """S-10: one Parquet folder for each host, older schemas allowed; also which expected hosts are missing."""
    frames = [spark.read.parquet(p).withColumn("host_dir", F.lit(h)) for h, p in sorted(hosts.items())]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    return union, [h for h in expected if h not in hosts]


def corpus_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """S-12: path, sha, bytes of each file."""
    return small_files(spark, root).select("path", F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))


def corpus_sha(snapshot: DataFrame) -> DataFrame:
    """S-12 and D-6: one digest of all files. Digests of ranges of paths are digested again, so that no list of all is gathered."""
    part = snapshot.withColumn("p", F.substring(F.sha2("path", 256), 1, 2)).groupBy("p").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "path", "sha"))), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", F.lit("\t"), "d"))), "\n"), 256).alias("corpus_sha"), F.sum("n").alias("files"))


def crontab_jobs(texts: DataFrame) -> DataFrame:
    """S-13: host, place, name, schedule, command of each line of six fields or more. texts: host, reachable, body."""
    lines = texts.filter("reachable").select("host", F.posexplode(F.split("body", "\n")).alias("place", "line")).filter(~F.trim("line").startswith("#"))
    fields = r"(?U)^\s*(\S+\s+\S+\s+\S+\s+\S+\s+\S+)\s+(\S.*)$"
    jobs = lines.filter(F.col("line").rlike(fields)).withColumn("command", T.strip(F.regexp_extract("line", fields, 2)))
    return jobs.select("host", "place", F.regexp_extract("command", r"(?U)^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_extract("line", fields, 1), r"(?U)\s+", " ").alias("schedule"), "command")


def parse_crontabs(texts: DataFrame) -> DataFrame:
    """S-13: host, jobs, comments, orphaned comments (those of a table that schedules nothing); jobs are null where the host couldn't be reached."""
    lines = texts.select("host", "reachable", F.explode_outer(F.split("body", "\n")).alias("line"))
    note = F.trim("line").rlike(r"^#+\s*\S")
    job = ~F.trim("line").startswith("#") & F.col("line").rlike(r"(?U)^\s*\S+(?:\s+\S+){5}")
    sums = lines.groupBy("host", "reachable").agg(F.count_if(job).alias("n"), F.count_if(note).alias("comments"))
    return sums.select("host", F.when(F.col("reachable"), F.col("n")).alias("jobs_found"), "comments", F.when(F.col("n") == 0, F.col("comments")).otherwise(0).alias("orphaned"))


def read_registries(spark: SparkSession, path: str) -> DataFrame:
    """S-11: name and path of each repository; a file is a list or {"repos": [...]}, a torn one is skipped."""
    whole = small_files(spark, path).select(F.col("content").cast("string").alias("value"), F.col("path").alias("file"))
    array = "array<struct<name: string, path: string>>"
    repos = F.coalesce(F.from_json("value", f"struct<repos: {array}>")["repos"], F.from_json("value", array))
    return whole.select("file", F.explode(repos).alias("r")).select("file", F.coalesce("r.name", F.lit("?")).alias("name"), "r.path")


def read_config(spark: SparkSession, toml: str, bounds: dict[str, tuple[float, float]], defaults: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """S-9: path, value, clamped, violated of each number; bounds by path, * for one step. defaults: a top-level table's numbers, for a file that can't be parsed or lacks that table."""
    import tomllib

    def walk(x: dict, at: tuple = ()):
        for k, v in x.items():
            if isinstance(v, dict):
                yield from walk(v, (*at, k))
            elif isinstance(v, int | float) and not isinstance(v, bool):
                yield ".".join((*at, k)), float(v)

    try:
        said = tomllib.loads(toml)
    except tomllib.TOMLDecodeError:
        said = {}
    said = {k: v for k, v in (defaults or {}).items() if not isinstance(said.get(k), dict)} | {k: v for k, v in said.items() if isinstance(v, dict) or k not in (defaults or {})}
    rows = []
    for path, v in walk(said):
        lo, hi = next((b for p, b in bounds.items() if fnmatch.fnmatchcase(path, p) and p.count(".") == path.count(".")), (float("-inf"), float("inf")))
        rows.append((path, v, lo, hi))
    df = spark.createDataFrame(rows, "path string, value double, lo double, hi double")
    return df.withColumn("clamped", F.least(F.greatest("value", "lo"), "hi")).withColumn("violated", F.col("clamped") != F.col("value"))
