"""What runs remember: counts of templates for each run, and a row for each run, as Parquet folders by project."""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jsondoc, score
from ..session import on_one_machine, shared_folder
from . import dictionary

HISTORY = "template_id long, count long, run_id string, run_ts long, project string"
DICTIONARIES = "data binary, runs long, run_id string, project string"
#: What mining goes on from: distinct beginnings of messages, and the templates of leaves.
BEGINNINGS = "root string, word_count int, head array<string>, first long"
LEAVES = "word_count int, path array<string>, k int, tokens array<string>, count long, first_record_id long"
#: Sketches of values by path (see operators.jsondoc), of every run.
SKETCHES = "path string, hll binary, kll binary"
TEMPLATES = "template_id long, pattern string, count long, run_id string, run_ts long, project string"


def state_root() -> str:
    """$XDG_STATE_HOME or ~/.local/state."""
    return os.path.join(os.environ.get("XDG_STATE_HOME") or os.path.expanduser("~/.local/state"), "sieveline")


def project_slug(folder: str | None = None) -> str:
    """A stable name for a working folder."""
    return hashlib.md5(os.path.abspath(folder or os.getcwd()).encode()).hexdigest()[:16]


class State:
    """History of one project, by default in the user's state folder, or on a cluster in the folder that it shares.  Scoring reads it before the run's own counts are appended, else nothing would be new."""

    def __init__(self, spark: SparkSession, root: str | None = None, project: str | None = None) -> None:
        home = state_root() if on_one_machine(spark) else f"{shared_folder(spark)}/sieveline"
        self.spark, self.root, self.project = spark, root or home, project or project_slug()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").filter(F.col("project") == self.project)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        return self._read("history", HISTORY).select("template_id", "count", "run_id", "run_ts")

    def templates(self) -> DataFrame:
        return self._read("templates", TEMPLATES)

    def sketches(self) -> DataFrame:
        """Sketches of all runs, put together."""
        return jsondoc.merged(self._read("sketches", f"{SKETCHES}, run_id string, project string").drop("run_id", "project"))

    def before(self, name: str, schema: str, run_id: str) -> DataFrame:
        """Rows that runs before `run_id` have put into the table `name`."""
        rows = self._read(name, f"{schema}, run_id string, project string").filter(F.col("run_id") < run_id)
        return rows.drop("run_id", "project")

    def latest(self, name: str, schema: str, run_id: str) -> DataFrame:
        """Rows of the last run before `run_id`."""
        rows = self._read(name, f"{schema}, run_id string, project string").filter(F.col("run_id") < run_id)
        last = rows.agg(F.max("run_id")).first()[0]
        return rows.filter(F.col("run_id") == F.lit(last)).drop("run_id", "project")

    def put(self, name: str, rows: DataFrame, run_id: str) -> None:
        self._write(rows.withColumns({"run_id": F.lit(run_id), "project": F.lit(self.project)}), name)

    def append(self, templates: DataFrame, run_id: str, run_ts: int) -> None:
        """Write the counts of a run; its partition is replaced if the run is repeated.

        `templates` may itself come from the history, so its rows are written beside that first, and the history is
        then written from what was written: a table is never read and replaced at once.
        """
        rows = templates.groupBy("template_id", "pattern").agg(F.sum("count").alias("count"))
        self._write(rows.withColumns({"run_id": F.lit(run_id), "run_ts": F.lit(run_ts), "project": F.lit(self.project)}), "templates")
        own = self.templates().filter(F.col("run_id") == run_id)
        self._write(own.groupBy("template_id", "run_id", "run_ts", "project").agg(F.sum("count").alias("count")), "history")

    def dictionary(self) -> bytes:
        """The project's compression dictionary; empty without one."""
        row = self._read("dictionaries", DICTIONARIES).orderBy(F.col("runs").desc()).first()
        return bytes(row["data"]) if row else b""

    def refresh_dictionary(self, lines: DataFrame) -> bool:
        """Train a dictionary on `lines` if there is none, or if it is time to (score.needs_retraining): many runs since, or
        templates far from those of the run it was made after.  Says whether it did."""
        runs = self.history().select("run_id", "run_ts").distinct().orderBy(F.col("run_ts").desc(), F.col("run_id").desc())
        count = runs.count()
        last = self._read("dictionaries", DICTIONARIES).select("runs", "run_id").orderBy(F.col("runs").desc()).first()
        now = runs.first()
        if now is None:
            return False
        if last is not None:
            counts = lambda run: self.history().filter(F.col("run_id") == run).select("template_id", "count")
            far = score.cosine_distance(counts(now["run_id"]), counts(last["run_id"])).first()["distance"]
            if not score.needs_retraining(count - last["runs"], far):
                return False
        data = dictionary.train(lines)
        if data:
            row = self.spark.createDataFrame([(bytearray(data), count, now["run_id"], self.project)], DICTIONARIES)
            self._write(row, "dictionaries")
        return bool(data)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "run_id").parquet(f"{self.root}/{name}")

    def reset(self) -> None:
        """Forget the project."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in ("history", "templates", "dictionaries", "beginnings", "leaves", "sketches"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/project={self.project}")
            p.getFileSystem(conf).delete(p, True)
