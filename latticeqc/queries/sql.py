"""Small SQL text helpers for the DuckDB side."""

NAN = "CAST('NaN' AS DOUBLE)"
INF = "CAST('Infinity' AS DOUBLE)"


def fin(a: str) -> str:
    return f"coalesce(isfinite({a}),false)"


def div(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {b}=0 THEN (CASE WHEN isnan({a}) OR {a}=0 THEN {NAN} WHEN {a}>0 THEN {INF} ELSE -{INF} END)"
        f" ELSE {a}/{b} END)"
    )


def r6(a: str) -> str:
    return f"(round({a},6)+0e0)"


def fr6(a: str) -> str:
    """Rounded when finite, else null."""
    return f"(CASE WHEN isfinite({a}) THEN round({a},6)+0e0 END)"


def above(a: str, b) -> str:
    return f"coalesce(NOT isnan({a}) AND {a}>{b},false)"


def below(a: str, b) -> str:
    return f"coalesce(NOT isnan({a}) AND {a}<{b},false)"


def dot(a: str, b: str) -> str:
    return f"({a}x*{b}x+{a}y*{b}y+{a}z*{b}z)"


def cross(out: str, a: str, b: str) -> str:
    return (
        f"({a}y)*({b}z)-({a}z)*({b}y) AS {out}x, ({a}z)*({b}x)-({a}x)*({b}z) AS {out}y, ({a}x)*({b}y)-({a}y)*({b}x) AS {out}z"
    )


def unit(out: str, a: str, length: str) -> str:
    return ", ".join(
        f"CASE WHEN {fin(length)} AND {length}>1e-12 THEN {a}{c}/{length} ELSE {NAN} END AS {out}{c}" for c in "xyz"
    )


def clip(a: str) -> str:
    return f"least(greatest({a},-1e0),1e0)"


def set_digest_sql(value: str) -> str:
    """Digest of a collection without order: hash of the count and of four sums of 60-bit parts of the hashes."""
    sums = ",".join(f"sum(CAST(concat('0x',substr(sha256({value}),{1 + 15 * i},15)) AS BIGINT))" for i in range(4))
    return f"sha256(concat_ws(':',count(*),{sums}))"
