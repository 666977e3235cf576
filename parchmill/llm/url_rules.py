"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path, in the syntax of public block lists: ``||`` in front ties
it to a host and its subdomains, ``|`` to the start or the end, ``*`` is any run of characters,
``^`` a separator (none of ``a-z A-Z 0-9 _ - . %``) or the end. Every other character is
itself. A pattern becomes a regular expression, but only urls that hold one of its literal tokens ever meet it:

* A token is a run of letters, digits and non-ASCII characters. A token of a pattern can be looked
  up if a url that matches must hold it as a whole token, so not next to ``*`` or an open end.
* How many urls hold each such token is counted in Spark over all urls. Every rule is filed under
  its rarest one. A rule without one is tried on every url.
* Each url's tokens fetch the rules filed under them. Only those run their expression, the
  longest first, until one fits.

The index travels to the tasks in blocks of at most ``BLOCK_RULES`` rules. A longer list takes
several passes, each written, and the longest rule of all passes wins. The urls are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.session import cut_lineage

BLOCK_RULES = 50_000
ALLOW, BLOCK = "allow", "block"
OUTPUT = ("host", "path", "rule", "verdict")

_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_token = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_SEPARATOR = r"(?:[^0-9A-Za-z_.%\x80-\U0010FFFF-]|\Z)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` decides which urls, ``name`` is what the result shows; the longest name wins."""

    verdict: str
    pattern: str
    name: str

    @property
    def rank(self) -> tuple[int, str, str]:
        """Smaller wins: the longer name, then the smaller one, then allow."""
        return -len(self.name), self.name, self.verdict


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``, characters as they are."""
    host = host.translate(str.maketrans(_CAPITALS, _SMALL))
    return Rule(verdict, "||" + _escaped(host) + _escaped(path), host + path)


def _escaped(text: str) -> str:
    return re.sub(r"([\\*^|])", r"\\\1", text)


def _pieces(pattern: str) -> list[str]:
    """The pattern as a list: ``*``, ``^``, ``|``, ``||`` and, marked by a leading ``=``, literal characters."""
    out = []
    for part in re.findall(r"\\.|\|\||.", pattern, re.DOTALL):
        out.append("=" + part[-1] if part[0] == "\\" or part not in ("*", "^", "|", "||") else part)
    return out


def expression(pattern: str) -> str:
    """The regular expression of a pattern, to be searched in host + path."""
    pieces, out = _pieces(pattern), []
    for at, piece in enumerate(pieces):
        if piece[0] == "=":
            out.append(re.escape(piece[1:]))
        elif piece == "*":
            out.append(r"[\s\S]*")
        elif piece == "^":
            out.append(_SEPARATOR)
        elif at == 0:
            out.append(r"\A(?:[^/]*\.)?" if piece == "||" else r"\A")
        elif at == len(pieces) - 1 and piece == "|":
            out.append(r"\Z")
        else:
            out.append(re.escape(piece))
    return "".join(out)


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every matching url holds whole: nothing that can be a letter or digit is next to them."""
    # Literal characters stand for themselves; a tie or a separator ends a token, "*" and an open end do not.
    marks = {"*": "\x00", "^": "/", "|": "/", "||": "/"}
    pieces = _pieces(pattern)
    shown = "\x00" + "".join(
        p[1:] if p[0] == "=" else marks[p] if p in "*^" or at in (0, len(pieces) - 1) else p
        for at, p in enumerate(pieces)
    ) + "\x00"
    return {m.group() for m in _token.finditer(shown) if shown[m.start() - 1] != "\x00" and shown[m.end()] != "\x00"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path. Both are empty for null and where there is no ``://``.

    The host ends before the first ``/``, ``?`` or ``#`` and keeps user, port and dots; the path, if
    not empty, starts with ``/`` and ends before ``?`` or ``#``.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), F.regexp_extract(rest, r"(?s)\A[^/]*([\s\S]*)\z", 1)


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """How many of the urls (host, path) hold each token. At most one row per token comes to the driver."""
    wanted = sorted(set(tokens))
    counts: dict[str, int] = {}
    for lo in range(0, len(wanted), BLOCK_RULES):
        block = wanted[lo : lo + BLOCK_RULES]
        listed = urls.sparkSession.createDataFrame([(t,) for t in block], "token string")
        held = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({_TOKEN})"), 1))
        found = urls.select(F.explode(held).alias("token")).join(F.broadcast(listed), "token").groupBy("token")
        counts |= {row["token"]: row["n"] for row in found.agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token (equally rare: the longer, then the smaller); None holds those without."""
    index: dict[str | None, list[Rule]] = {}
    for rule in rules:
        tokens = literal_tokens(rule.pattern)
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else None
        index.setdefault(rarest, []).append(rule)
    return index


def judge(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = ALLOW, block_rules: int = BLOCK_RULES
) -> DataFrame:
    """Add host, path, rule and verdict to every row: those of the longest rule that fits the url.

    Without one, rule is null and the verdict ``default``: a list of patterns lets pass what it does not
    name. Equal rules count once; of equally long names the smaller wins, of one name allow. A null, an empty url
    and one without ``://`` have empty host and path, and only a pattern that matches the empty text fits them.
    Rows come out once each, equal ones too; an empty table gives an empty result. Input columns
    named host, path, rule or verdict are replaced.
    """
    if url in OUTPUT:
        raise ValueError(f"the url column can't be named {url}")
    host, path = host_and_path(F.col(url))
    kept = pages.select([c for c in pages.columns if c == url or c not in OUTPUT])
    urls = kept.withColumns({"host": host, "path": path})
    known = sorted(set(rules), key=lambda r: r.rank)
    counts = token_counts(urls, (t for r in known for t in literal_tokens(r.pattern)))
    judged = urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # Blocks go from the longest rules to the shortest, so a row that has a rule keeps it.
    for lo in range(0, len(known), block_rules):
        if lo:
            judged = cut_lineage(judged)
        index = build_index(known[lo : lo + block_rules], counts)
        judged = judged.mapInArrow(_apply(index), judged.schema)
    return judged


def _apply(index: dict[str | None, list[Rule]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[Rule, re.Pattern] = {}

        def winner(place: str) -> Rule | None:
            found = list(index.get(None, ()))
            for token in set(_token.findall(place)):
                found += index.get(token, ())
            for rule in sorted(found, key=lambda r: r.rank):
                fits = compiled.get(rule)
                if fits is None:
                    fits = compiled[rule] = re.compile(expression(rule.pattern))
                if fits.search(place):
                    return rule
            return None

        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            names, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for at, name in enumerate(names):
                if name is None and (rule := winner(hosts[at] + paths[at])) is not None:
                    names[at], verdicts[at] = rule.name, rule.verdict
            made = {"rule": pa.array(names, pa.string()), "verdict": pa.array(verdicts, pa.string())}
            columns = [made.get(f.name, batch.column(f.name)) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run
