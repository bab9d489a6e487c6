"""Version specifiers of requirements and npm packages as intervals of version keys.

A specifier is a union of half-open intervals `low <= key < high` over the keys of
`functions.versions`; a NULL bound is open.  Exclusive and inclusive ends need no flag, since
there is a bound right after each key.  All of it is built-in column expressions, meant for
distinct specifiers, of which there are few however many repositories declare them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsift.functions import versions

INTERVALS = "array<struct<low:array<string>,high:array<string>>>"

_PRE = r"(?:[-_.]?(?:dev|alpha|a|beta|b|preview|pre|rc|c)[-_.]?\d*)?"
_CLAUSE = rf"(?i)^(===?|~=|~>|~|\^|!=|<=|>=|<|>|=)?v?(\d+(?:\.\d+)*{_PRE})((?:\.[*x])*)$"
_ANY = r"(?i)^(?:[*x](?:\.[*x])*)?$"
_PYTHON_OPERATORS = ["==", "===", "~=", "!=", "<=", ">=", "<", ">"]
_NODE_OPERATORS = ["", "=", "~", "~>", "^", "<=", ">=", "<", ">"]


def _python_clauses(specifier: Column) -> Column:
    """One alternative: clauses parted by commas, without blanks and local versions."""
    bare = F.regexp_replace(specifier, r"\s+|\+[A-Za-z0-9.]+", "")
    return F.array(F.filter(F.split(bare, ","), lambda clause: clause != ""))


def _node_clauses(specifier: Column) -> Column:
    """Alternatives parted by `||`, each of clauses parted by blanks; `a - b` is `>=a <=b`."""
    bare = F.regexp_replace(specifier, r"\+[0-9A-Za-z.-]+", "")
    bare = F.regexp_replace(bare, r"(<\s*v?\d+(?:\.\d+)*)-0(?![0-9A-Za-z.-])", "$1")

    def clauses(alternative: Column) -> Column:
        comparators = F.regexp_replace(F.trim(alternative), r"^(\S+)\s+-\s+(\S+)$", ">=$1 <=$2")
        return F.filter(F.split(F.regexp_replace(comparators, r"([\^~<>=]+)\s+", "$1"), r"\s+"), lambda clause: clause != "")

    return F.transform(F.split(bare, r"\|\|"), clauses)


def _is_known(ecosystem: Column, clause: Column) -> Column:
    operator = F.regexp_extract(clause, _CLAUSE, 1)
    wild = F.regexp_extract(clause, _CLAUSE, 3) != ""
    several = F.size(versions.numbers(F.regexp_extract(clause, _CLAUSE, 2))) > 1
    python = (operator.isin(_PYTHON_OPERATORS) & (~wild | operator.isin("==", "!="))
              & ((operator != "~=") | several))
    written = clause.rlike(_CLAUSE) & F.when(ecosystem == "python", python).otherwise(operator.isin(_NODE_OPERATORS))
    return written | ((ecosystem != "python") & clause.rlike(_ANY))


def _read(clause: Column) -> Column:
    """The clause's parts, computed once however often they are used."""
    version = F.regexp_extract(clause, _CLAUSE, 2)
    return F.struct(
        F.regexp_extract(clause, _CLAUSE, 1).alias("operator"), (F.regexp_extract(clause, _CLAUSE, 3) != "").alias("wild"),
        version.alias("version"), versions.numbers(version).alias("numbers"), versions.version_key(version).alias("key"))


def _ranges(ecosystem: Column, clause: Column) -> Column:
    """The intervals of one clause."""
    operator, wild, version, numbers, key = (clause[c] for c in ("operator", "wild", "version", "numbers", "key"))
    node = ecosystem != "python"
    partial = wild | (node & (F.size(numbers) < 3) & ~versions.is_prerelease(version))
    open_end = F.lit(None).cast("array<string>")

    def one(low: Column, high: Column) -> Column:
        return F.array(F.struct(low.alias("low"), high.alias("high"))).cast(INTERVALS)

    def below_next(size: Column) -> Column:
        return versions.ceiling_key(F.slice(numbers, F.lit(1), size))

    past_all = versions.ceiling_key(numbers)
    floor = versions.floor_key(version)
    last = F.when(partial, past_all).otherwise(versions.key_after(key))
    leading = F.array_position(F.transform(numbers, lambda n: ~n.rlike("^0+$")), True).cast("int")
    caret = F.when(leading == 0, F.size(numbers)).otherwise(leading)
    return (F.when(operator == "", F.when(version == "", one(open_end, open_end)).otherwise(one(key, last)))
            .when(operator.isin("=", "==", "==="), one(key, last))
            .when(operator == "!=", F.concat(one(open_end, F.when(wild, floor).otherwise(key)), one(last, open_end)))
            .when(operator == ">=", one(key, open_end))
            .when(operator == ">", one(last, open_end))
            .when(operator == "<", one(open_end, F.when(versions.is_prerelease(version), key).otherwise(floor)))
            .when(operator == "<=", one(open_end, last))
            .when(operator == "^", one(key, below_next(caret)))
            .when(operator == "~=", one(key, below_next(F.size(numbers) - 1)))
            .otherwise(one(key, below_next(F.least(F.size(numbers), F.lit(2))))))


def _meet(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["low"], b["low"]).alias("low"), F.least(a["high"], b["high"]).alias("high"))


def _all_of(ecosystem: Column, clauses: Column) -> Column:
    """What all clauses allow: at most one interval more than there are `!=` among them."""
    everything = F.array(F.struct(F.lit(None).alias("low"), F.lit(None).alias("high"))).cast(INTERVALS)
    parts = F.transform(F.transform(clauses, _read), lambda clause: _ranges(ecosystem, clause))

    def narrowed(allowed: Column, ranges: Column) -> Column:
        met = F.flatten(F.transform(allowed, lambda a: F.transform(ranges, lambda b: _meet(a, b))))
        return F.filter(met, lambda i: F.coalesce(i["low"] < i["high"], F.lit(True))).cast(INTERVALS)

    return F.aggregate(parts, everything, narrowed)


def intervals(ecosystem: Column, specifier: Column) -> Column:
    """The versions a specifier allows, as intervals of version keys; NULL unless understood.

    No specifier (empty text, `*`) allows all versions; one that nothing meets (`>2,<1`) gives no
    interval.  Addresses, tags, epochs and post-releases are not understood.  A bound that is a
    release leaves out its own pre-releases, as both kinds of package manager do unless asked:
    `<2.0`, `^1.2` and `1.*` allow neither `2.0rc1` nor `1.0rc1`.
    """
    alternatives = F.when(ecosystem == "python", _python_clauses(specifier)).otherwise(_node_clauses(specifier))
    known = F.forall(alternatives, lambda clauses: F.forall(clauses, lambda clause: _is_known(ecosystem, clause)))
    return F.when(known, F.flatten(F.transform(alternatives, lambda clauses: _all_of(ecosystem, clauses))))


def is_single(allowed: Column) -> Column:
    """Whether the intervals allow exactly one version."""
    only = F.try_element_at(allowed, F.lit(1))
    return (F.size(allowed) == 1) & F.coalesce(only["high"] == versions.key_after(only["low"]), F.lit(False))
