"""Component usages and imports of TSX pages.

``lexical`` says where a page's elements stand, whatever is nested in what, and for ``page_usages`` where their names
are imported from; rows and import statements are DataFrame operations. No page meets another, so nothing is shuffled. As in the reference data model, tags
inside attribute values are no usages, HTML tags and fragments are transparent, lines and columns start
at 1 and columns count bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import lexical
from weftline.functions.lexical import with_elements, with_shapes

IMPORT = "(?m)^" + lexical.IMPORT


def usages(pages: DataFrame, id_col: str = "page_id", code_col: str = "code") -> DataFrame:
    """Component usages: ``id_col, pos, component_name, props, has_children, parent_component, line, column``.

    ``pos`` numbers a page's usages from 0. ``props`` maps a tag's attributes: the text of string literals,
    ``''`` for expressions, ``'true'`` for bare names; the last of equal names counts, a spread is
    ``...spread``, names with a colon are left out. A null code has no usages; pages are read row by row, also where
    they share an id.
    """
    each = with_elements(pages, code_col, id_col).select(id_col, F.posexplode("_elements").alias("pos", "_e"))
    return each.select(id_col, "pos", F.col("_e.name").alias("component_name"), "_e.props", "_e.has_children", F.col("_e.parent").alias("parent_component"), "_e.line", "_e.column")


def page_usages(pages: DataFrame, id_col: str = "page_id", code_col: str = "code") -> DataFrame:
    """Usages with what their page says of them, equal ones of a slice of pages as one row: ``component_name, props, parent_component, source, children, places``.

    ``source`` is where the page imports the name from, null if nowhere: the last import of a name counts, a statement's default
    name after its named ones. ``children`` has the names that stand in any usage of that name on the page. ``places`` are ``page_id, page, line``;
    ``page`` numbers the pages, also of one id. Pages without usages are places of a row whose ``component_name`` is null.
    """
    return with_shapes(pages, code_col, id_col)


def _names(text: Column) -> Column:
    """Names between an import's braces; aliases keep the exported name."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_extract(x, lexical.IMPORTED, 1)), lambda x: x != "")


def imports(pages: DataFrame, id_col: str = "page_id", code_col: str = "code") -> DataFrame:
    """Import statements: ``id_col, pos, source, names, default_name``; aliases keep the exported name.

    Namespace imports name nothing; imports for their effect are kept without names.
    """
    code = F.coalesce(F.col(code_col), F.lit(""))
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(code, F.lit(IMPORT), 0)).alias("pos", "_i"))
    part = lambda n: F.regexp_extract("_i", IMPORT, n)
    return found.select(id_col, "pos", part(3).alias("source"), _names(part(2)).alias("names"), part(1).alias("default_name"))
