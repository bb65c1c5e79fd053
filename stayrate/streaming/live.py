"""Live scoring of hypothetical profiles that arrive as files.

Scoring keeps no state between rows, so the stream needs no watermark; the checkpoint
only records which files have been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stayrate.operators import profiles
from stayrate.operators.scorecard import Scorecard
from stayrate.session import new_folder


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON profiles that appear in ``folder``."""
    return spark.readStream.schema(profiles.PROFILE).json(folder)


def score_stream(stream: DataFrame, card: Scorecard) -> DataFrame:
    return profiles.score_profiles(stream, card)


def start(stream: DataFrame, card: Scorecard, out: str, checkpoint: str | None = None,
          once: bool = False) -> StreamingQuery:
    """Append assessed profiles to a Parquet folder; ``once`` drains what is there and ends."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, "profile-stream")
    scored = score_stream(stream, card).select(
        "Profile_ID", "Churn_Probability", "Risk_Category", "Main_Risk_Factors",
        "Recommended_Action")
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", checkpoint))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
