"""Readers and writers: article folders, JSONL logs and journals, calendars, paper archives, source trees."""

from __future__ import annotations

import ast
import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = """url string, article struct<url:string,title:string,sections:array<struct<level:int,text:string,position:int>>,hyperlinks:array<struct<href:string,text:string,outbound:boolean>>,
code_blocks:array<string>,emphasis_map:struct<bold_count:int,italic_count:int,quote_count:int>,dom_depth:int>, concepts struct<equations:array<string>,
parameters:array<struct<symbol:string,value:double,units:string,context:string>>,technical_terms:array<string>,has_experiment:boolean>, ingested_at double"""


def read_articles(spark: SparkSession, path: str, skip: str = "seen_urls.json") -> DataFrame:
    """One JSON document a file; the bookkeeping file is left out."""
    docs = spark.read.schema(ARTICLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return docs.select("*", F.col("_metadata.file_name").alias("file_name")).where(~F.col("file_name").endswith(skip))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Known fields only: unknown ones are dropped, missing ones null."""
    return spark.read.schema(schema).json(path)


def recover_journal(spark: SparkSession, path: str, schema: str, window: int) -> DataFrame:
    """A journal's last points before its first corrupt line, file by file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    bad = F.try_parse_json("line").isNull()
    first = F.min(F.when(bad, F.col("pos"))).over(Window.partitionBy("file"))
    good = lines.withColumn("_f", first).where(F.col("_f").isNull() | (F.col("pos") < F.col("_f"))).withColumn("p", F.from_json("line", schema))
    last = good.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("pos")))).where(F.col("_r") <= window)
    return last.select("file", "pos", "p.*")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(kind, d): the meeting dates as `fed`, all exchange holidays of any year as `holiday`, of a JSON object of arrays."""
    text = spark.read.text(path, wholetext=True)
    kinds = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "dates"))
    kind = F.when(F.col("name") == "fomc_meeting_dates", "fed").when(F.col("name").startswith("nyse_holidays"), "holiday")
    return kinds.select(kind.alias("kind"), F.explode("dates").alias("s")).where("kind is not null").select("kind", F.to_date("s").alias("d")).distinct()


def read_paper_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of archives: the .tex members of a tar (compressed or not), else the text of a gzip, else the
    file itself."""

    def unpack(frames):
        for pdf in frames:
            out = []
            for p, blob in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
                        out += [(p, m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar if m.isfile() and m.name.endswith(".tex")]
                except tarfile.TarError:
                    try:
                        blob = gzip.decompress(blob)
                    except (OSError, EOFError):
                        pass
                    out.append((p, "", blob.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, name string, text string")


PIPELINE = "tickers array<struct<symbol:string,sector:string,price:double,momentum:double,volatility:double>>, correlations array<struct<a:string,b:string,corr:double>>, sentiments map<string,double>, articles array<struct<ticker:string,sentiment:double>>"


def explode_pipeline(df: DataFrame) -> dict[str, DataFrame]:
    """A nested document's four tables, with the usual values for what is missing."""
    t = df.select(F.inline("tickers")).select("symbol", F.coalesce("sector", F.lit("unknown")).alias("sector"), F.coalesce("price", F.lit(100.0)).alias("price"), F.coalesce("momentum", F.lit(0.0)).alias("momentum"), F.coalesce("volatility", F.lit(0.01)).alias("volatility"))
    c = df.select(F.inline("correlations")).select("a", "b", F.coalesce("corr", F.lit(0.0)).alias("corr"))
    return {"tickers": t, "correlations": c, "sentiments": df.select(F.explode("sentiments").alias("symbol", "sentiment")), "articles": df.select(F.inline("articles"))}


def python_modules(files: DataFrame) -> DataFrame:
    """(module, imports, calls, bases, defines, complexity) of Python sources (path, value); files that do not parse give
    no row."""

    def read(frames):
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError):
                    continue
                imports, calls, bases, defines, branches = [], [], [], [], 1
                for n in ast.walk(tree):
                    if isinstance(n, ast.Import):
                        imports += [a.name for a in n.names]
                    elif isinstance(n, ast.ImportFrom) and n.module:
                        imports.append(n.module)
                    elif isinstance(n, ast.Call):
                        calls.append(getattr(n.func, "id", getattr(n.func, "attr", "")))
                    elif isinstance(n, ast.ClassDef):
                        defines.append(n.name)
                        bases += [getattr(b, "id", getattr(b, "attr", "")) for b in n.bases]
                    elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        defines.append(n.name)
                    branches += isinstance(n, (ast.If, ast.For, ast.While, ast.Try, ast.BoolOp))
                name = path.rsplit("/", 1)[-1].removesuffix(".py")
                out.append((name, sorted(set(imports)), sorted(set(calls) - {""}), sorted(set(bases) - {""}), defines, float(branches)))
            yield pd.DataFrame(out, columns=["module", "imports", "calls", "bases", "defines", "complexity"])

    return files.select("path", "value").mapInPandas(read, "module string, imports array<string>, calls array<string>, bases array<string>, defines array<string>, complexity double")


def python_functions(files: DataFrame, least_lines: int = 3) -> DataFrame:
    """(path, name, n_lines, n_args, doc) of public functions of at least so many lines."""

    def read(frames):
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_") and n.end_lineno - n.lineno + 1 >= least_lines:
                        out.append((path, n.name, n.end_lineno - n.lineno + 1, len(n.args.args), ast.get_docstring(n)))
            yield pd.DataFrame(out, columns=["path", "name", "n_lines", "n_args", "doc"])

    return files.select("path", "value").mapInPandas(read, "path string, name string, n_lines int, n_args int, doc string")
