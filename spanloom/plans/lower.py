"""From query expressions to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import shared
from ..operators import intervals as I
from .expr import Expr


def lower(e: Expr, collection) -> DataFrame:
    """The interval list of e over a collection (see model.Collection), per document."""
    k, args = e.kind, e.args
    if k == "term":
        return collection.term(e.term)
    if k == "fixed":
        return I.all_windows(collection.lengths(), e.n)
    if k == "materialize":
        return shared.materialize(lower(args[0], collection), "intervals")
    if k == "link":
        return I.link(lower(args[0], collection))
    if k in ("and", "or", "of", "seq") and len(args) == 1:
        return I.plain(lower(args[0], collection))
    if k in ("and", "of"):
        return I.n_of(e.n if k == "of" else len(args), len(args), _tagged(args, collection, need=e.n if k == "of" else len(args)))
    if k == "or":
        return I.plain(I.minimal(_tagged(args, collection, need=1)))
    if k == "seq":
        left = lower(args[0], collection)
        for a in args[1:]:
            left = I.followed_by(left, lower(a, collection))
        return left
    if len(args) > 2:  # left-deep
        return lower(Expr(k, (Expr(k, args[:-1]), args[-1])), collection)
    a, b = args
    if k == "has" and a.kind == "fixed":
        if b.kind == "seq" and len(b.args) == a.n and all(x.kind == "term" for x in b.args):
            return I.phrase(_tagged(b.args, collection, need=a.n), a.n)
        return I.windows_in(lower(b, collection), a.n, collection.lengths())
    if k == "in" and a.kind == "fixed":
        return I.windows_inside(lower(b, collection), a.n)
    if b.kind == "fixed":
        n = b.n
        test = {"in": lambda w: w <= n, "not_in": lambda w: w > n, "has": lambda w: w >= n, "not_has": lambda w: w < n}[k]
        return I.width(lower(a, collection), test)
    f = {"in": I.contained_in, "has": I.containing, "not_in": I.not_contained_in, "not_has": I.not_containing}[k]
    return f(lower(a, collection), lower(b, collection))


def _tagged(args: tuple, collection, need: int) -> DataFrame:
    """The union of operands with their numbers; terms only are read in one scan of documents that hold `need` of them."""
    if all(x.kind == "term" for x in args):
        return collection.tagged_terms([x.term for x in args], need)
    return I.tagged([lower(x, collection) for x in args])
