"""Pages and figures of files as a table function: one file in, a row a page or figure out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: What an extractor tells of a page or figure; ``problem`` is added.
PAGE = "type string, page int, text string, image bigint"
Extract = Callable[[bytes], Iterable[tuple]]


def page_table(extract: Extract, schema: str = PAGE):
    """S13, S14, G16. A table function of (path, content) around an extractor, to be joined laterally or registered for SQL.

    Rows have the extractor's columns and ``problem``. A file whose extractor fails
    gives the rows that came before, and one of nulls with the problem; a null
    content gives none. Rows leave one by one, so a file's pages are never held
    together. Arguments of other types are refused when the query is analysed.
    """
    columns = T.StructType.fromDDL(schema)
    result = T.StructType([*columns, T.StructField("problem", T.StringType())])
    nothing = (None,) * len(columns)

    class Pages:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(path.dataType, T.StringType) or not isinstance(content.dataType, T.BinaryType):
                raise ValueError("pages are read from (path string, content binary)")
            return AnalyzeResult(result)

        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            if content is None:
                return
            try:
                for row in extract(bytes(content)):
                    yield (*row, None)
            except Exception as e:  # noqa: BLE001
                yield (*nothing, f"{type(e).__name__}: {e}")

    return F.udtf(Pages)


def page_rows(files: DataFrame, extract: Extract, schema: str = PAGE, name: str = "pages") -> DataFrame:
    """S13, S14, G16, T-6. (path, the extractor's columns, problem) of binary files; what was read is observed under ``name`` while the query runs."""
    table = page_table(extract, schema)
    rows = files.select("path", "content").lateralJoin(table(F.col("path").outer(), F.col("content").outer())).drop("content")
    return rows.observe(name, F.count_if(F.col("problem").isNull()).alias("rows"), F.count_if(F.col("problem").isNotNull()).alias("failed"))


def form_feed_pages(content: bytes) -> Iterator[tuple]:
    """Stand-in of a PDF reader: UTF-8 pages parted by form feeds, and figures as lines ``[figure n]``."""
    for n, page in enumerate(content.decode().rstrip("\n").split("\f"), 1):
        lines = page.split("\n")
        yield ("page_text", n, "\n".join(x for x in lines if not x.startswith("[figure ")), None)
        for x in lines:
            if x.startswith("[figure "):
                yield ("figure", n, None, int(x[8:-1]))
