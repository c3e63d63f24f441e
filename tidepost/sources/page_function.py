"""Saved pages in SQL: a table function whose columns follow its arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidepost.operators.markup import Element, read_page


def parse_fields(spec: str) -> list[tuple[str, str, str | None]]:
    """``name=selector`` or ``name=selector@attribute``, parted by ``;``. The selector ``.`` is the container itself."""
    out = []
    for part in spec.split(";"):
        name, found, where = part.partition("=")
        selector, _, attribute = where.strip().partition("@")
        if not found or not name.strip() or not selector:
            raise ValueError(f"a field is name=selector or name=selector@attribute, not {part!r}")
        out.append((name.strip(), selector.strip(), attribute.strip() or None))
    if len({name for name, _, _ in out}) < len(out) or "pos" in {name for name, _, _ in out}:
        raise ValueError("field names must differ, and none may be pos")
    return out


def field_value(box: Element, selector: str, attribute: str | None) -> str | None:
    element = box if selector == "." else box.find(selector)
    if element is None:
        return None
    return element.attrs.get(attribute) if attribute else element.text()


class PageRecords:
    """``page_records(html, containers, fields)``: ``pos`` and one text column for each field.

    ``containers`` is a selector, ``fields`` as in ``parse_fields``; both must be constants, since the
    columns follow them. A null page has no records; what a container lacks is null.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, containers: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not containers.isConstantExpression or not fields.isConstantExpression or not fields.value:
            raise ValueError("containers and fields must be constant texts")
        columns = [T.StructField(name, T.StringType()) for name, _, _ in parse_fields(fields.value)]
        return AnalyzeResult(T.StructType([T.StructField("pos", T.IntegerType()), *columns]))

    def eval(self, html: str | None, containers: str, fields: str) -> Iterator[tuple]:
        if html is None:
            return
        wanted = parse_fields(fields)
        for pos, box in enumerate(read_page(html).find_all(containers)):
            yield (pos, *[field_value(box, selector, attribute) for _, selector, attribute in wanted])


def register_page_records(spark: SparkSession, name: str = "page_records") -> None:
    """Make the function known to SQL of this session."""
    spark.udtf.register(name, udtf(PageRecords))
