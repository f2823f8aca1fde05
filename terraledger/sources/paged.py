"""A paged table service as a Spark data source.

``spark.read.format("paged").option("fetch", "package.module:function")`` where
the function is ``fetch(where, offset, limit) -> list of dicts`` and
``fetch(where, None, None) -> row count``.  Pages become partitions, filters on
single columns are sent to the service as ``where`` text, and each page is
retried with linear back-off.  A page that comes back short raises: the scan is
whole or fails.  ``start`` and ``most`` resume a scan at a row and bound it, as a
journal of finished pages would have it.

With ``ids`` the function is ``fetch(where, None, None) -> list of ids`` and
``fetch(where, ids, None) -> rows``: chunks of ids become partitions, and an id
that is missing from its chunk raises.  With ``bbox`` (x0,y0,x1,y1) and ``grid``
(nx,ny) it is ``fetch(where, (x0, y0, x1, y1), None) -> rows``: tiles become
partitions; what lies on a border comes once for each tile, so the caller drops
duplicates by key.
"""

from __future__ import annotations

import importlib
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Page(InputPartition):
    def __init__(self, offset, limit: int | None, expected: int | None):
        self.offset, self.limit, self.expected = offset, limit, expected


def _call(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.fetch, self.options = schema, options["fetch"], dict(options)
        self.size, self.tries, self.pause = int(options.get("pagesize", 2000)), int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.where: list[str] = [w for w in [options.get("where", "")] if w]

    def pushFilters(self, filters):
        for f in filters:
            sign = _SIGNS.get(type(f))
            plain = isinstance(getattr(f, "value", None), (str, int, float)) and not isinstance(f.value, bool)
            if sign and len(f.attribute) == 1 and plain:
                value = "'" + f.value.replace("'", "''") + "'" if isinstance(f.value, str) else f.value
                self.where.append(f"{f.attribute[0]} {sign} {value}")
            else:
                yield f

    def partitions(self):
        if "bbox" in self.options:
            x0, y0, x1, y1 = (float(v) for v in self.options["bbox"].split(","))
            nx, ny = (int(v) for v in self.options.get("grid", "1,1").split(","))
            w, h = (x1 - x0) / nx, (y1 - y0) / ny
            return [Page((x0 + i * w, y0 + j * h, x0 + (i + 1) * w, y0 + (j + 1) * h), None, None) for i in range(nx) for j in range(ny)]
        found = self._again(None, None)
        if self.options.get("ids"):
            return [Page(found[i : i + self.size], None, len(found[i : i + self.size])) for i in range(0, len(found), self.size)]
        start = int(self.options.get("start", 0))
        end = min(found, start + int(self.options.get("most", found)))
        return [Page(at, min(self.size, end - at), min(self.size, end - at)) for at in range(start, end, self.size)]

    def read(self, page: Page):
        rows = self._again(page.offset, page.limit)
        if page.expected is not None and len(rows) != page.expected:
            raise RuntimeError(f"page at {page.offset} has {len(rows)} of {page.expected} rows")
        for r in rows:
            yield tuple(r.get(f.name) for f in self.schema.fields)

    def _again(self, offset, limit):
        for k in range(self.tries):
            try:
                return _call(self.fetch)(" and ".join(self.where), offset, limit)
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.pause * (k + 1))


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
