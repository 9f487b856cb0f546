"""Train a layer, score run files with stored layers, or score the files that arrive in a folder.

python -m plantpulse train LAYER.yaml [forest|boosted]
python -m plantpulse predict --status MODEL [--warning MODEL] [--failure MODEL] --out FOLDER FILE...
python -m plantpulse stream --status MODEL [--warning MODEL] [--failure MODEL] --out FOLDER --checkpoint FOLDER SOURCE
"""

import argparse
import sys

from pyspark.sql import SparkSession

from .columns import CSV_OPTIONS, SENSORS
from .plans.layer import run_layer
from .plans.saved import SavedLayers, run_stream, score_files
from .plans.spec import LayerSpec


def arguments(given: list[str]) -> argparse.Namespace:
    """Parsed arguments; a YAML file in the place of the command is trained."""
    if given and given[0].endswith((".yaml", ".yml")):
        given = ["train", *given]
    parser = argparse.ArgumentParser(prog="plantpulse", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train")
    train.add_argument("spec")
    train.add_argument("kind", nargs="?", default="forest", choices=["forest", "boosted"])
    for name in ("predict", "stream"):
        own = commands.add_parser(name)
        own.add_argument("--status", required=True)
        own.add_argument("--warning")
        own.add_argument("--failure")
        own.add_argument("--out", required=True)
        own.add_argument("--window", default="10min")
        if name == "predict":
            own.add_argument("--condition", default="unknown", choices=["normal", "abnormal", "unknown"])
            own.add_argument("files", nargs="+")
        else:
            own.add_argument("--checkpoint", required=True)
            own.add_argument("--measurement", default="sensor_measurements")
            own.add_argument("--sensors", nargs="+", default=list(SENSORS))
            own.add_argument("--keep-running", action="store_true")
            own.add_argument("source")
    return parser.parse_args(given)


def main(spark: SparkSession, given: list[str]) -> None:
    wanted = arguments(given)
    if wanted.command == "train":
        _, metrics, report = run_layer(spark, LayerSpec.from_yaml(wanted.spec), wanted.kind)
        metrics.show()
        report.show(truncate=False)
        return
    layers = SavedLayers.load(spark, wanted.status, wanted.warning, wanted.failure)
    if wanted.command == "predict":
        verdicts = score_files(spark, layers, wanted.files, wanted.condition, wanted.window)
        verdicts.write.mode("overwrite").options(**CSV_OPTIONS).csv(wanted.out)
    else:
        query = run_stream(spark, layers, wanted.source, wanted.out, wanted.checkpoint, wanted.sensors, wanted.measurement, not wanted.keep_running)
        query.awaitTermination()


if __name__ == "__main__":
    main(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:])
