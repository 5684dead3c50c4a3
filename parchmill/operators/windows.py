"""Windows over the rows of one page, in page order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# What tells one page from another: its id, and a number of its row, as ids may
# repeat. Rows are spread by both, so pages of one id do not meet in one task.
PAGE = ["page_id", "page_no"]


def numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with ``page_no``, a number of each row, unless they have one.

    It follows the order of files and rows, so whoever reads the table again
    gets the same numbers.
    """
    return pages if "page_no" in pages.columns else pages.withColumn("page_no", F.monotonically_increasing_id())


def by_page() -> WindowSpec:
    return Window.partitionBy(*PAGE).orderBy("pos")


def so_far(*keys: str) -> WindowSpec:
    """From the start of the page (and ``keys`` group) to the current row."""
    window = Window.partitionBy(*PAGE, *keys).orderBy("pos")
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return by_page().rowsBetween(Window.unboundedPreceding, -1)


def from_here() -> WindowSpec:
    """From the current row to the end of the page, as a running window from the end."""
    backwards = Window.partitionBy(*PAGE).orderBy(F.col("pos").desc())
    return backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_page() -> WindowSpec:
    return by_page().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
