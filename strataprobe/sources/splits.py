"""Files read in byte ranges by many tasks: whole texts, numbered lines, and the values of JSON documents.

Spark's text source opens the files, whatever store they are in, and cuts large ones; `files` are rows of bundles.listing
(path, rel, length), whose names alone come to the driver. Files up to a size are a row each. Of larger ones lines get their numbers
from counts of each byte range, added up, and whole-file JSON is cut at the commas of its outermost list:

1. Each range between commas says what its brackets come to, once if it begins outside a string and once if inside.
2. These sums are composed in file order, which gives each range's true beginning. That is one small row a range.
3. Each range is cut with that beginning; what reaches over an edge, two pieces a range at most, is put together again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graphs import cut
from ..operators.search import numbered_lines

#: Files up to so many bytes are read as one row each.
WHOLE_BYTES = 32 << 20
#: Byte ranges or files up to which their table is broadcast.
BROADCAST_ROWS = 500_000

STRINGS = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
NO_BRACKET = re.compile(r"[^\[\]{}]+")
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[\[\]{},]', re.S)
#: Open brackets within which a document is cut: none, a list's elements, an object's members, elements of a list that is a member.
LEVELS = ("", "[", "{", "{[")


def names_of(files: DataFrame) -> list[tuple[str, str, int]]:
    return [tuple(r) for r in files.select("path", "rel", "length").collect()]


def divided(files: DataFrame, whole_bytes: int | None = None) -> tuple[list, list]:
    """(small, large) rows of files, by size."""
    most = WHOLE_BYTES if whole_bytes is None else whole_bytes
    rows = names_of(files)
    return [r for r in rows if r[2] <= most], [r for r in rows if r[2] > most]


def located(path: str) -> str:
    """A path with its scheme; without one it is local."""
    return path if "://" in path or path.startswith("file:") else "file://" + path


def _pattern(path: str) -> str:
    """A path as a pattern that only it matches."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", located(path))


def _known(spark: SparkSession, rows: list) -> DataFrame:
    """file, as Spark's metadata name it, and rel, bytes."""
    uri = spark._jvm.org.apache.hadoop.fs.Path
    shown = [(re.sub("^file:/+", "file:///", uri(located(p)).toUri().toString()), rel, n) for p, rel, n in rows]
    out = spark.createDataFrame(shown, "file string, rel string, bytes long")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def _file() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")


def _reader(spark: SparkSession):
    return spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def _there(spark: SparkSession, rows: list) -> list:
    """Rows whose file can still be named: those that went since they were listed are passed over."""
    if not rows:
        return []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs: dict[str, object] = {}
    out = []
    for row in rows:
        p = jvm.org.apache.hadoop.fs.Path(located(row[0]))
        at = located(row[0]).partition(":")[0]
        if at not in fs:
            fs[at] = p.getFileSystem(conf)
        if fs[at].exists(p):
            out.append(row)
    return out


def hidden(row) -> bool:
    """Names that Spark's readers pass over."""
    name = row[0].rpartition("/")[2]
    return name.startswith((".", "_")) or name.endswith("._COPYING_")


def there(spark: SparkSession, rows: list) -> list:
    """Rows that Spark's readers can open."""
    return _there(spark, [r for r in rows if not hidden(r)])


def whole_texts(spark: SparkSession, rows: list) -> DataFrame:
    """rel, text of the files, a row each; bad bytes become U+FFFD. Names with a leading dot or underscore, which Spark's readers
    pass over, are opened by path in a task."""
    seen = [r for r in rows if not hidden(r) and r[2]]
    dotted = [r for r in rows if hidden(r) and r[2]]
    out = spark.createDataFrame([(r[1], "") for r in rows if not r[2]], "rel string, text string")
    if seen := _there(spark, seen):
        texts = _reader(spark).text([_pattern(r[0]) for r in seen], wholetext=True).select(_file().alias("file"), F.make_valid_utf8("value").alias("text"))
        out = out.unionByName(texts.join(_known(spark, seen), "file").select("rel", "text"))
    if dotted:

        def read(frames):
            for frame in frames:
                for path, rel in zip(frame["path"], frame["rel"]):
                    try:
                        with open(path.removeprefix("file://"), "rb") as f:
                            yield pd.DataFrame({"rel": [rel], "text": [f.read().decode("utf-8", "replace")]})
                    except OSError:
                        continue

        out = out.unionByName(spark.createDataFrame(dotted, "path string, rel string, length long").repartition(len(dotted)).mapInPandas(read, "rel string, text string"))
    return out


def ranges(spark: SparkSession, rows: list, separator: str | None = None) -> DataFrame:
    """file, block (where its byte range begins), id (rising in file order within a range), value (undecoded)."""
    reader = _reader(spark) if separator is None else _reader(spark).option("lineSep", separator)
    text = reader.text([_pattern(r[0]) for r in rows])
    return text.select(_file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _broadcast(spark: SparkSession, df: DataFrame, rows: list) -> DataFrame:
    """df, with some rows for each byte range of the files, broadcast if these are few enough."""
    most = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    size = max(1, int(most)) if most.isdigit() else 1 << 20
    return F.broadcast(df) if sum(r[2] // size + 1 for r in rows) <= BROADCAST_ROWS else df


def before_each(counts: DataFrame, by: str = "file") -> DataFrame:
    """counts(by, block, n) with the sum of n over earlier blocks, as before."""
    w = Window.partitionBy(by).orderBy("block")
    return counts.withColumn("before", F.sum("n").over(w) - F.col("n"))


def split_lines(spark: SparkSession, rows: list) -> DataFrame:
    """rel, block, line_no, line of files that many tasks read: a range's lines are numbered from the lines before it. A
    byte order mark at a file's head is left out."""
    lines = ranges(spark, rows)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    met = lines.join(_broadcast(spark, before_each(counts), rows), ["file", "block"]).join(_known(spark, rows), "file")
    return met.select("rel", "block", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.make_valid_utf8("value").alias("line"))


def lines(files: DataFrame, whole_bytes: int | None = None) -> DataFrame:
    """path (relative), block (where the byte range that holds it begins; 0 in a file read whole), line_no from 1, line of every
    file: \\n, \\r and \\r\\n end a line, bad bytes become U+FFFD."""
    spark = files.sparkSession
    small, large = divided(files, whole_bytes)
    visible = there(spark, large)
    small += [r for r in large if hidden(r)]
    out = numbered_lines(whole_texts(spark, small), "rel", "text").select("path", F.lit(0).cast("long").alias("block"), F.col("line_no").cast("long").alias("line_no"), "line")
    if visible:
        out = out.unionByName(split_lines(spark, visible).select(F.col("rel").alias("path"), "block", "line_no", "line"))
    return out


def heads(files: DataFrame, chars: int | None = None, size: int | None = None, whole_bytes: int | None = None) -> DataFrame:
    """rel, text: the first so many characters or bytes of each file, by default all. Of large files the ranges that begin within them alone count,
    cut at commas or at lines, whichever the name says the file is made of, until enough is there."""
    spark = files.sparkSession
    small, large = divided(files, whole_bytes)
    most = chars if chars is not None else size
    if most is None:
        return whole_texts(spark, small + large)
    out = whole_texts(spark, small + [r for r in large if hidden(r)])
    for separator in (",", "\n"):
        some = _there(spark, [r for r in large if not hidden(r) and (r[1].endswith(".json") == (separator == ","))])
        if not some:
            continue
        piece = F.make_valid_utf8("value")
        parts = ranges(spark, some, separator).where(F.col("block") < most * (4 if chars is not None else 1)).withColumn("piece", piece)
        w = Window.partitionBy("file").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("seen", F.coalesce(F.sum((F.length("piece") if chars is not None else F.octet_length("piece")) + 1).over(w), F.lit(0))).where(F.col("seen") < most)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "piece"))), lambda x: x["piece"]), separator)
        joined = parts.groupBy("file").agg(text.alias("text")).join(_known(spark, some), "file")
        more = F.when(F.octet_length("text") < F.col("bytes"), separator).otherwise("")
        out = out.unionByName(joined.select("rel", F.concat("text", more).alias("text")))
    if chars is not None:
        return out.withColumn("text", F.substring("text", 1, chars))
    return out.withColumn("text", F.when(F.octet_length("text") <= size, F.col("text")).otherwise(F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, size).cast("string"))))


def stretches(files: DataFrame, whole_bytes: int = 1 << 20) -> DataFrame:
    """rel, text: every file from end to end, a row each, or, if it is large, one for each stretch between commas or line ends, whichever the
    name says the file is made of. What holds neither, as a timestamp, lies in one row."""
    spark = files.sparkSession
    small, large = divided(files, whole_bytes)
    out = whole_texts(spark, small + [r for r in large if hidden(r)])
    for separator in (",", "\n"):
        if some := there(spark, [r for r in large if r[1].endswith(".json") == (separator == ",")]):
            out = out.unionByName(ranges(spark, some, separator).join(_known(spark, some), "file").select("rel", F.make_valid_utf8("value").alias("text")))
    return out


def hashes(files: DataFrame, most: int = 512 << 20) -> DataFrame:
    """rel, sha256 of each file; ERROR if it can't be read. Hashing is a chain, so each file is one task's: in the JVM, or, beyond
    `most` bytes, by path, in pieces."""
    spark = files.sparkSession
    rows = [r for r in names_of(files) if r[2]]
    seen = there(spark, [r for r in rows if r[2] <= most])
    rest = [r for r in rows if hidden(r) or r[2] > most]
    out = spark.createDataFrame([], "rel string, sha256 string")
    if seen:
        content = _reader(spark).format("binaryFile").load([_pattern(r[0]) for r in seen]).select(_file().alias("file"), F.sha2("content", 256).alias("sha256"))
        out = content.join(_known(spark, seen), "file").select("rel", "sha256")
    if rest:

        def read(frames):
            for frame in frames:
                for path, rel in zip(frame["path"], frame["rel"]):
                    h = hashlib.sha256()
                    try:
                        with open(path.removeprefix("file://"), "rb") as f:
                            while piece := f.read(1 << 20):
                                h.update(piece)
                    except OSError:
                        continue
                    yield pd.DataFrame({"rel": [rel], "sha256": [h.hexdigest()]})

        out = out.unionByName(spark.createDataFrame(rest, "path string, rel string, length long").repartition(len(rest)).mapInPandas(read, "rel string, sha256 string"))
    known = F.coalesce("sha256", F.when(F.col("length") == 0, F.sha2(F.lit(""), 256)).otherwise("ERROR"))
    return files.select("rel", "length").join(out, "rel", "left").select("rel", known.alias("sha256"))


def unreadable(files: DataFrame) -> DataFrame:
    """rel, error of files that are gone or may not be read; none is opened."""
    spark = files.sparkSession
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path, rel, _ in names_of(files):
        p = jvm.org.apache.hadoop.fs.Path(located(path))
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            out.append((rel, "FileNotFoundError"))
            continue
        try:
            fs.access(p, jvm.org.apache.hadoop.fs.permission.FsAction.READ)
        except Py4JJavaError:
            out.append((rel, "PermissionError"))
    return spark.createDataFrame(out, "rel string, error string")


# whole-file JSON ------------------------------------------------------------------------------------
def reduced(brackets: str) -> str:
    """Brackets without pairs that close each other: closing ones, then opening ones, if they fit."""
    while True:
        n = len(brackets)
        brackets = brackets.replace("[]", "").replace("{}", "")
        if len(brackets) == n:
            return brackets


class Shape:
    """What a stretch of text does to the brackets around it, from outside a string or from inside one."""

    def __init__(self, quoted: bool):
        self.quoted, self.brackets = quoted, ""

    def feed(self, text: str) -> None:
        at = 0
        if self.quoted:
            m = REST_OF_STRING.match(text)
            if m is None:
                return
            at, self.quoted = m.end(), False
        rest = STRINGS.sub("", text[at:])
        quote = rest.find('"')
        if quote >= 0:
            rest, self.quoted = rest[:quote], True
        self.brackets = reduced(self.brackets + NO_BRACKET.sub("", rest))


class Cutter:
    """Cuts a range, fed in parts, at the commas and brackets of LEVELS."""

    def __init__(self, stack: str, quoted: bool, starts: bool):
        self.stack, self.quoted = stack, quoted
        self.parts: list[str] = []
        self.rows: list[tuple] = []
        self.k, self.cont, self.tail, self.key = 0, not starts, False, None

    def _cut(self, text: str, by: str) -> None:
        text = "".join(self.parts) + text
        self.rows.append((self.k, self.stack, by, self.cont, self.tail, self.key if self.stack.startswith("{[") else None, text))
        if self.stack == "{" and by == "[":
            self.key = None if self.cont else member_key(text)
        self.parts, self.k, self.cont = [], self.k + 1, False
        self.tail = self.stack == "{[" and by == "]"

    def feed(self, text: str) -> None:
        at = start = 0
        if self.quoted:
            m = REST_OF_STRING.match(text)
            if m is None:
                self.parts.append(text)
                return
            start, self.quoted = m.end(), False
        for m in TOKENS.finditer(text, start):
            t = m.group()
            if t[0] == '"':
                if m.end() == len(text) and STRINGS.fullmatch(t) is None:
                    self.quoted = True
            elif t == ",":
                if self.stack in LEVELS[1:]:
                    self._cut(text[at : m.start()], t)
                    at = m.end()
            elif t in "[{":
                if self.stack + t in LEVELS:
                    self._cut(text[at : m.start()], t)
                    at = m.end()
                self.stack += t
            else:
                if self.stack in LEVELS[1:]:
                    self._cut(text[at : m.start()], t)
                    at = m.end()
                self.stack = self.stack[:-1]
        self.parts.append(text[at:])

    def end(self) -> list[tuple]:
        self._cut("", "")
        return self.rows


def compact(value, encode=json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode) -> str:
    return encode(value)


def member_key(text: str) -> str | None:
    """The key in '"key":' before a list; None if it is none."""
    try:
        found = json.loads("{" + text + "[]}")
    except ValueError:
        return None
    return next(iter(found)) if len(found) == 1 and next(iter(found.values())) == [] else None


def _runs(batches) -> Iterator[tuple[str, int, str, bool, int, dict]]:
    """(file, block, text, whether the range begins here, bytes, its other columns) of neighbouring chunks of one range, commas put back."""
    last = None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = list(zip(columns["file"], columns["block"]))
        at, n = 0, len(keys)
        while at < n:
            end = at + 1
            while end < n and keys[end] == keys[at]:
                end += 1
            new = keys[at] != last
            text = ",".join(v.decode("utf-8", "replace") for v in columns["value"][at:end])
            size = sum(map(len, columns["value"][at:end])) + end - at - 1
            if not new or keys[at][1]:
                text, size = "," + text, size + 1
            yield *keys[at], text, new, size, {name: columns[name][at] for name in columns}
            last, at = keys[at], end


SUMMARY = "file string, block long, out_quoted boolean, out_brackets string, in_quoted boolean, in_brackets string, size long"


def shapes(chunks: DataFrame) -> DataFrame:
    """A row of SUMMARY for each byte range of chunks(file, block, value)."""

    def run(batches):
        now, key, size = None, None, 0

        def row():
            a, b = now
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, a.quoted, a.brackets, b.quoted, b.brackets, size)], [c.split()[0] for c in SUMMARY.split(", ")])

        for file, block, text, new, n, _ in _runs(batches):
            if new:
                if now:
                    yield row()
                now, key, size = (Shape(False), Shape(True)), (file, block), 0
            for shape in now:
                shape.feed(text)
            size += n
        if now:
            yield row()

    return chunks.select("file", "block", "value").mapInArrow(run, SUMMARY)


def beginnings(summary: DataFrame) -> DataFrame:
    """file, block, stack, quoted: in what each range begins, and whole: whether the brackets of the file close."""

    def fold(frame):
        frame = frame.sort_values("block")
        stack, quoted, out, fits = "", False, [], True
        for r in frame.itertuples():
            out.append((r.file, r.block, stack, quoted))
            stack = reduced(stack + (r.in_brackets if quoted else r.out_brackets))
            quoted = r.in_quoted if quoted else r.out_quoted
            fits = fits and not any(c in "]}" for c in stack)
        done = pd.DataFrame(out, columns=["file", "block", "stack", "quoted"])
        done["whole"] = fits and not stack and not quoted
        return done

    return summary.groupBy("file").applyInPandas(fold, "file string, block long, stack string, quoted boolean, whole boolean")


def judge(level: str, by: str, tail: bool, text: str) -> tuple[str | None, str | None, bool, str]:
    """(name, head, good, text) of a piece: the key of a member, that of a list that is opened, whether its text is what JSON
    allows there, and text compact (of a member the value)."""
    if not text.strip(" \t\n\r"):
        return None, None, not (level == "{" and by == "["), ""
    try:
        if level in ("[", "{["):
            return None, None, True, compact(json.loads(text))
        if level == "{" and not tail and by == "[":
            head = member_key(text)
            return head, head, head is not None, text
        if level == "{" and not tail:
            member = json.loads("{" + text + "}")
            name = next(iter(member))
            return name, None, len(member) == 1, compact(member[name])
    except (ValueError, StopIteration):
        pass
    return None, None, False, text


PIECES = "file string, block long, k long, level string, by string, cont boolean, tail boolean, key string, text string"
JUDGED = PIECES + ", name string, head string, good boolean"
ARROW = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for c in JUDGED.split(", ")])


def pieces(chunks: DataFrame) -> DataFrame:
    """chunks(file, block, value, stack, quoted) of files whose brackets close -> the pieces between cuts, in order of (block, k), judged. Those
    that lie in one range are judged where they are cut, so that their texts are written once."""

    def rows(key, found):
        out = []
        for k, level, by, cont, tail, name, text in found:
            said = (None, None, True, text) if cont or not by else judge(level, by, tail, text)
            out.append((*key, k, level, by, cont, tail, name, said[3], *said[:3]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    def run(batches):
        now, key = None, None
        for file, block, text, new, _, given in _runs(batches):
            if new:
                if now:
                    yield rows(key, now.end())
                now, key = Cutter(given["stack"], given["quoted"], starts=block == 0), (file, block)
            now.feed(text)
            if len(now.rows) >= 1000:
                yield rows(key, now.rows)
                now.rows = []
        if now:
            yield rows(key, now.end())

    def met(frames):
        for f in frames:
            said = [judge(*r) for r in zip(f["level"], f["by"], f["tail"], f["text"])]
            yield f.assign(name=[x[0] for x in said], head=[x[1] for x in said], good=[x[2] for x in said], text=[x[3] for x in said])

    raw = cut(chunks.select("file", "block", "value", "stack", "quoted").mapInArrow(run, JUDGED))
    part = raw.where("cont or by = ''")
    w = Window.partitionBy("file").orderBy("block", "k")
    groups = part.withColumn("g", F.sum(F.when(F.col("cont"), 0).otherwise(1)).over(w)).groupBy("file", "g")
    place = F.struct("block", "k")
    joined = groups.agg(
        F.min(F.struct("block", "k", "tail", "key")).alias("a"), F.max(F.struct("block", "k", "level", "by")).alias("z"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "text"))), lambda x: x["text"]), "").alias("text")
    )
    joined = joined.select("file", "a.block", "a.k", "z.level", "z.by", F.lit(False).alias("cont"), "a.tail", "a.key", "text")
    return raw.where("not cont and by <> ''").unionByName(cut(joined.mapInPandas(met, JUDGED)))


def lined(spark: SparkSession, rows: list, probe: int = 65_536) -> set:
    """Those of the large files that hold JSON by lines, for all their first bytes tell: a whole line is a document and another
    begins after it. Such a file is no single document."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), set()
    for row in rows:
        if row[2] <= probe:
            continue
        path = jvm.org.apache.hadoop.fs.Path(located(row[0]))
        stream = path.getFileSystem(conf).open(path)
        try:
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, probe)).decode("utf-8", "replace")
        finally:
            stream.close()
        first, _, rest = head.lstrip().partition("\n")
        try:
            json.loads(first)
        except ValueError:
            continue
        if rest.strip():
            out.add(row)
    return out


def split_documents(spark: SparkSession, rows: list, numbered: bool = True) -> tuple[DataFrame | None, dict[str, dict]]:
    """(elements, documents) of those of the large files that are one JSON list or object each.

    documents: by rel, {"top": "[" or "{", "lists": keys of members that are lists, in order, or null if keys repeat}. elements:
    rel, key (null in a list file), block, k, position (from 1), value (compact JSON) of these lists, and of other members with
    position null, but of none where keys repeat. Files that are no such document are in neither. Not numbered: plain, whether it is of
    another member, in the place of position."""
    by_line = lined(spark, rows)
    rows = [r for r in rows if r not in by_line]
    if not rows:
        return None, {}
    chunks = ranges(spark, rows, ",").withColumn("value", F.col("value").cast("binary"))
    known = _known(spark, rows)
    summary = cut(shapes(chunks))
    sized = summary.groupBy("file").agg(F.sum("size").alias("size")).join(known, "file").where(F.col("size") == F.col("bytes")).select("file")
    begin = cut(beginnings(summary).where("whole").join(sized, "file", "left_semi"))
    found = pieces(chunks.join(_broadcast(spark, begin, rows), ["file", "block"]))
    blank = F.col("text") == ""
    lists = found.where("not tail and level <> ''").groupBy("file", "level", F.coalesce("key", F.lit("")).alias("key")).agg(F.count("*").alias("n"), F.count_if(blank).alias("blanks"))
    gaps = lists.where("level in ('[', '{') and blanks > 0 and n > 1").select("file").distinct()
    outside = F.col("level") == ""
    shape = found.groupBy("file").agg(
        F.bool_and("good").alias("good"), F.count_if(outside).alias("ends"), F.min(F.when(outside & (F.col("by") != ""), F.col("by"))).alias("top"), F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("block", "k", "head")))).alias("heads"),
        (F.count("name") > F.count_distinct("name")).alias("repeats"),
    )
    shape = shape.where("good and ends = 2 and top in ('[', '{')").join(gaps, "file", "left_anti").join(known, "file")
    docs = shape.select("file", "rel", "top", F.when(~F.col("repeats"), F.col("heads.head")).alias("lists")).collect()
    if not docs:
        return None, {}
    # an element's list: named in its own range, else the last one opened in a range before
    last = found.where("head is not null").groupBy("file", "block").agg(F.max_by("head", "k").alias("opened"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = begin.select("file", "block").join(last, ["file", "block"], "left").withColumn("carried", F.last("opened", ignorenulls=True).over(w)).select("file", "block", "carried")
    carried = cut(carried)
    good = spark.createDataFrame([(r["file"], r["rel"]) for r in docs if r["lists"] is not None], "file string, rel string")
    inner = found.where("level in ('[', '{[') or (level = '{' and by <> '[' and name is not null)").join(F.broadcast(good) if len(docs) <= BROADCAST_ROWS else good, "file")
    inner = inner.join(_broadcast(spark, carried, rows), ["file", "block"], "left")
    key = F.when(F.col("level") == "{[", F.coalesce("key", "carried")).when(F.col("level") == "{", F.col("name"))
    inner = inner.select("rel", key.alias("key"), "block", "k", F.col("text").alias("value"), (F.col("level") == "{").alias("plain"))
    several = inner.where("not plain").groupBy("rel", "key").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("blanks"))
    bad = {r["rel"] for r in several.where("blanks > 0 and n > 1").select("rel").distinct().collect()}
    kept = {r["rel"]: {"top": r["top"], "lists": r["lists"]} for r in docs if r["rel"] not in bad}
    inner = inner.where(~F.col("rel").isin(sorted(bad)) if bad else F.lit(True)).where("value <> ''")
    if not numbered:
        return inner, kept
    place = F.concat_ws("\u0001", "rel", "key")
    listed = ordinals(inner.where("not plain").withColumn("place", place), "place", ["k"], "position").drop("place", "plain")
    return listed.unionByName(inner.where("plain").drop("plain").withColumn("position", F.lit(None).cast("long"))), kept


def ordinals(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """df(by, block, ..) with the number, from 1, of each row within by: counts of each block added up, and a window over one block."""
    counts = df.groupBy(by, "block").agg(F.count("*").alias("n"))
    local = F.row_number().over(Window.partitionBy(by, "block").orderBy(*order))
    return df.withColumn(name, local).join(before_each(counts, by).drop("n"), [by, "block"]).withColumn(name, F.col(name) + F.col("before")).drop("before")
