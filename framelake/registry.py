"""Registered queries and their SQL counterparts. Logical tables are bound to the driver's tables by
portable SQL, so both engines see the same input."""
from framelake.bindings import BASE, VIEWS

QUERIES: dict = {}
ORACLES: dict = {}
#: Rows of an input table for each partition of a shuffle (fewer where a row is a whole text), and bytes of a shuffle or of files that one task reads.
ROWS_EACH, TEXTS_EACH = 200_000, {"documents": 2_500, "pages": 2_500, "conversations": 20_000}
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.files.maxPartitionBytes": "32m"}


def follow_input(spark, rows, each=ROWS_EACH):
    """Partitions of a shuffle follow the rows of the input, so what a task sorts or aggregates is bounded at every size and is not
    spilled; small shuffles are put together again by adaptive execution, up to TASK_BYTES. A session that has more partitions, or
    a size of its own, keeps it."""
    for name, size in TASK_BYTES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, size)
    if rows > each * int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(-(-rows // each)))


class Tables:
    """Lazily resolved logical tables: Tables(spark, dir).media is a DataFrame."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir, self._seen = spark, sf_dir.rstrip("/"), {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")      # wall clocks must not shift

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
                follow_input(self.spark, df.count(), TEXTS_EACH.get(name, ROWS_EACH))        # from the files' footers
            else:
                deps, sql = VIEWS[name][0], VIEWS[name][1]
                text = sql[0] if isinstance(sql, tuple) else sql
                df = self.spark.sql(text, **{d: getattr(self, d) for d in deps})
            self._seen[name] = df
        return self._seen[name]

    def once(self, name, key):
        """Writes a logical table, dealt out by key; those that derive from it read what is written. For queries that meet it many times."""
        from framelake.plans.similarity import written_by
        self._seen[name] = written_by(getattr(self, name), key)
        return self


def _ordered(names, seen=None):
    seen = [] if seen is None else seen
    for n in names:
        if n in VIEWS and n not in seen:
            _ordered(VIEWS[n][0], seen)
            seen.append(n)
    return seen


def oracle_text(uses, body, ctes=()):
    """DuckDB text: the logical tables as CTEs, then the query body."""
    parts = []
    for n in _ordered(uses):
        deps, sql = VIEWS[n][0], VIEWS[n][1]
        text = sql[1] if isinstance(sql, tuple) else sql
        parts.append(f"{n} AS ({text.format(**{d: d for d in deps})})")
    parts += [f"{n} AS ({t})" for n, t in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(key, uses=(), sql=None, ctes=(), recursive=False):
    """@query('AG-01', uses=['media'], sql='SELECT …') registers fn(tables) -> DataFrame."""
    def deco(fn):
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = oracle_text(uses, sql, ctes)
            ORACLES[key] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn
    return deco
