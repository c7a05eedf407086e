"""Query registry: name, Spark callable and the SQL that has to give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeqc.queries.fixtures import CTES, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return fn

    return register


def define(name: str, text: str) -> None:
    """Add a named SQL building block for oracles."""
    if name in CTES:
        raise ValueError(f"duplicate block {name}")
    CTES[name] = text.strip()


def define_over(prefix: str, name: str, base: str) -> None:
    """Copy the block ``name``, and all blocks between it and ``base``, to prefixed blocks that read ``prefix + base`` instead.

    Prefixed blocks that exist already stay as they are.
    """

    def named(text: str) -> list[str]:
        return [w for w in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([A-Za-z_]\w*)", text)) if w in CTES]

    above: dict[str, bool] = {base: True}

    def reaches(block: str) -> bool:
        if block not in above:
            above[block] = False  # a recursive block names itself
            above[block] = any([reaches(w) for w in named(CTES[block])])
        return above[block]

    reaches(name)
    chain = [w for w, used in above.items() if used]
    pattern = re.compile(rf"\b(FROM|JOIN)(\s+)({'|'.join(chain)})\b")
    for block in chain:
        if block != base and prefix + block not in CTES:
            define(prefix + block, pattern.sub(rf"\1\2{prefix}\3", CTES[block]))


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the blocks it names, directly or through other blocks."""
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in CTES and word not in order and word not in inside:
                visit(CTES[word], (*inside, word))
                if word not in order:
                    order.append(word)

    visit(body, ())
    if not order:
        return body.strip()
    def block(name: str) -> str:
        recursive = re.search(rf"\b{name}\b", CTES[name])
        return f"{name} AS {'' if recursive else 'MATERIALIZED '}({CTES[name]})"

    blocks = ",\n".join(map(block, order))
    return f"WITH RECURSIVE {blocks}\n{body.strip()}"
