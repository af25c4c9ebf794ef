"""Commands: validate CATALOG [DAY] prints the issues by record and exits with 1 if one is an error; rebuild CATALOG
TABLE [KEY] writes the query table anew and says how many records it has (KEY: that of the list in a document that is
an object)."""

from __future__ import annotations

import datetime
import sys

from pyspark.sql import SparkSession

from millrace.operators import validation
from millrace.plans import jobs
from millrace.sources import catalog, exports


def validate(spark: SparkSession, path: str, day: str | None = None) -> int:
    if not catalog.is_list(spark, path):
        print("(catálogo)\n  ERROR: El catálogo debe ser un arreglo.")
        return 1
    raw = catalog.read_raw(spark, path)
    issues, good = jobs.validate(validation.untyped(raw), day or datetime.date.today().isoformat())
    for row in exports.issue_report(issues, raw.count()).toLocalIterator():
        print(row.line)
    return 0 if good else 1


def rebuild(spark: SparkSession, path: str, table: str, key: str | None = None) -> int:
    print(catalog.rebuild_from(spark, path, table, key))
    return 0


def main(arguments: list[str]) -> int:
    commands = {"validate": validate, "rebuild": rebuild}
    if not arguments or arguments[0] not in commands:
        print(__doc__)
        return 2
    return commands[arguments[0]](SparkSession.builder.getOrCreate(), *arguments[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
