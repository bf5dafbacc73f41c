"""Small tables made by hand."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def matrix(spark, rows, value="e"):
    """Rows of numbers as `node, win, i, ts, <value>`."""
    cells = [
        (f"n{n}", k, k, START + timedelta(minutes=k), None if x is None else float(x))
        for n, row in enumerate(rows)
        for k, x in enumerate(row)
    ]
    return spark.createDataFrame(cells, f"node string, win int, i int, ts timestamp, {value} double")


def by(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.orderBy(*columns).collect()]
