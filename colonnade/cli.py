"""Command line: ``python -m colonnade.cli COMMAND TABLE ...``; TABLE is a table's folder, or a document file that is used in place."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from .errors import ColonnadeError, InsertError, QueryError
from .operators.constraints import Constraints
from .operators.join import inner_join, parse_on
from .operators.query import as_table, in_utc
from .operators.vector_search import parse_vector
from .sources import files
from .sources.document import Document, parse_document
from .sources.inplace import DocumentFile
from .store import Table, apply_json, elapsed
from .types import kind_of, parse_columns


def _names(text: str | None) -> list[str]:
    return [c.strip() for c in text.split(",") if c.strip()] if text else []


def _json(text: str, kind: type, what: str):
    try:
        found = json.loads(text)
    except ValueError as e:
        raise InsertError(f"{what} is not JSON: {e}") from e
    if not isinstance(found, kind):
        raise InsertError(f"{what} must be a JSON {'object' if kind is dict else 'array'}")
    return found


def _open(spark: SparkSession, path: str) -> Table | DocumentFile:
    return DocumentFile(spark, path) if os.path.isfile(path) else Table.open(spark, path)


def _show(df) -> None:
    for line in as_table(df.columns, in_utc(df).toLocalIterator()):
        print(line)


def create(spark, a):
    rules = Constraints(a.primary_key, _names(a.unique), _names(a.not_null), _json(a.default, dict, "--default") if a.default else {})
    columns = parse_columns(a.columns)
    if a.document:
        if os.path.exists(a.table):
            raise QueryError(f"a file exists at {a.table}")
        doc = Document(columns, {c: [] for c, _ in columns}, rules)
        files.save(parse_document(json.loads(files.to_json(doc))), a.table, a.document)
    else:
        Table.create(spark, a.table, columns, rules)
    print(f"created {a.table}")


def import_(spark, a):
    print(f"imported {Table.from_document(spark, a.table, files.load(a.file)).version.row_count} rows")


def validate(spark, a):
    _open(spark, a.table).check()
    print("valid")


def insert(spark, a):
    if (a.row is None) == (a.rows is None):
        raise InsertError("give one of --row and --rows")
    rows = [_json(a.row, dict, "--row")] if a.row is not None else _json(a.rows, list, "--rows")
    table = _open(spark, a.table)
    print(f"inserted {table.insert(rows)} rows, {table.row_count} in all")


def delete(spark, a):
    print(f"deleted {_open(spark, a.table).delete(a.where)} rows")


def update(spark, a):
    print(f"updated {_open(spark, a.table).update(a.where, _json(a.set, dict, '--set'))} rows")


def query(spark, a):
    _show(_open(spark, a.table).query(a.where, _names(a.select), a.limit))


def info(spark, a):
    table = _open(spark, a.table)
    held = table.version if isinstance(table, Table) else table.doc
    rules, indexes = held.rules, held.layouts if isinstance(table, Table) else held.indexes
    print("\n".join([*table.describe(), f"rows {table.row_count}"]))
    for name, kind in held.columns:
        marks = [m for m, on in (("primary key", name == rules.primary_key), ("unique", name in rules.unique), ("not null", name in rules.not_null), (f"default {json.dumps(rules.defaults.get(name))}", name in rules.defaults), (f"{indexes.get(name)} index", name in indexes)) if on]
        print(f"  {name}: {kind}" + (f"  [{', '.join(marks)}]" if marks else ""))


def export(spark, a):
    doc = _open(spark, a.table).to_document()
    if a.output:
        files.save(doc, a.output, a.format, a.pretty)
    elif a.format == "json":
        print(files.to_json(doc, a.pretty))
    else:
        raise QueryError("binary forms need --output")


def aggregate(spark, a):
    _show(_open(spark, a.table).aggregate(a.column, a.function, a.where))


def add_column(spark, a):
    _open(spark, a.table).add_column(a.name, a.type)
    print(f"added {a.name}")


def search(spark, a):
    _show(_open(spark, a.table).search(a.column, parse_vector(a.vector), a.top_k, a.metric, _names(a.select)))


def explain(spark, a):
    print(_open(spark, a.table).explain(a.where))


def txn(spark, a):
    done = apply_json(_open(spark, a.table), _json(a.ops, list, "--ops"))
    print(f"committed {len(done)} operations on {sum(done)} rows")


def create_index(spark, a):
    _open(spark, a.table).create_layout(a.column, a.type)
    print(f"indexed {a.column}")


def drop_index(spark, a):
    _open(spark, a.table).drop_layout(a.column)
    print(f"dropped the index of {a.column}")


def build_vector_index(spark, a):
    Table.open(spark, a.table).build_vector_index(a.column)
    print(f"indexed {a.column}")


def analyze(spark, a):
    for c, s in _open(spark, a.table).analyze().items():
        print(f"{c}: {json.dumps(s, default=str)}")


def compact(spark, a):
    _open(spark, a.table).compact()
    print("compacted")


def join(spark, a):
    left, right = _open(spark, a.table).df, _open(spark, a.right).df
    out = inner_join(left, right, *parse_on(a.on), as_text=a.as_text)
    if not a.output:
        for r in in_utc(out).toLocalIterator():
            print(json.dumps(r.asDict(), default=str, ensure_ascii=False))
        return
    target = Table.create(spark, a.output, [(f.name, kind_of(f.dataType)) for f in out.schema])
    print(f"joined {target.append(out)} rows")


_OPTIONS = {
    create: ("--columns!", "--primary-key", "--unique", "--not-null", "--default", "--document"),  # --document json, binary or compressed: a file
    import_: ("file",),  # a document file becomes a table
    validate: (), info: (), analyze: (), compact: (),
    insert: ("--row", "--rows"),
    delete: ("--where!",),
    update: ("--where!", "--set!"),
    query: ("--where", "--select", "--limit#"),
    export: ("--format=json", "--output", "--pretty?"),
    aggregate: ("--column!", "--function!", "--where"),
    add_column: ("--name!", "--type!"),
    search: ("--column!", "--vector!", "--top-k#5", "--metric=cosine", "--select"),
    explain: ("--where!",),
    txn: ("--ops!",),
    create_index: ("--column!", "--type!"),
    drop_index: ("--column!",),
    build_vector_index: ("--column!",),
    join: ("right", "--on!", "--output", "--as-text?"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="colonnade")
    commands = out.add_subparsers(required=True)
    for f, options in _OPTIONS.items():
        name = f.__name__.strip("_").replace("_", "-")
        for alias in (name, "check") if f is validate else (name,):
            p = commands.add_parser(alias)
            p.set_defaults(run=f)
            p.add_argument("table")
            for o in options:
                if o.endswith("!"):
                    p.add_argument(o[:-1], required=True)
                elif o.endswith("?"):
                    p.add_argument(o[:-1], action="store_true")
                elif "#" in o:
                    flag, _, value = o.partition("#")
                    p.add_argument(flag, type=int, default=int(value) if value else None)
                else:
                    flag, equals, value = o.partition("=")
                    p.add_argument(flag, **({"default": value} if equals else {}))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 1 and a message on errors; the time taken goes to standard error."""
    args, began = parser().parse_args(argv), time.time()
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true").getOrCreate()
    try:
        args.run(spark, args)
    except (ColonnadeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        print(elapsed(began), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
