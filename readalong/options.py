"""Options of a run, and the check that everything it needs is there."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Defaults of a run.  Fixed values: 400 characters a chunk with 200 more allowed, MP3 on, references removed, chunk audio deleted."""

    chunk_size: int = 400
    allowance: int = 200
    generate_mp3: bool = True
    remove_references: bool = True
    keep_chunks: bool = False
    output_dir: str = "output"

    @property
    def longest(self) -> int:
        """Longest chunk."""
        return self.chunk_size + self.allowance

    def problems(self) -> list[str]:
        """All that is wrong with these options."""
        found = []
        if self.chunk_size <= 0:
            found.append(f"chunk_size must be positive, not {self.chunk_size}")
        if self.allowance < 0:
            found.append(f"allowance must not be negative, not {self.allowance}")
        if not self.output_dir:
            found.append("output_dir is empty")
        return found

    def checked(self) -> Options:
        """These options; ValueError with all problems at once."""
        if problems := self.problems():
            raise ValueError("Options: " + "; ".join(problems))
        return self

    def as_rows(self, spark: SparkSession) -> DataFrame:
        """(name, value) of every option, as text."""
        return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in asdict(self).items()], "name string, value string")


def preflight(requirements: DataFrame) -> DataFrame:
    """(job_id, ok, n_missing, message) of each job's requirements (job_id, name, present): all that is missing in one message."""
    missing = F.array_sort(F.collect_list(F.when(~F.coalesce("present", F.lit(False)), F.col("name"))))
    found = requirements.groupBy("job_id").agg(missing.alias("missing"))
    message = F.when(F.size("missing") > 0, F.concat(F.lit("Dependency check failed: "), F.array_join("missing", ", ")))
    return found.select("job_id", (F.size("missing") == 0).alias("ok"), F.size("missing").cast("long").alias("n_missing"), message.alias("message"))
