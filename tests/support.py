"""What test modules share: the data folder and small helpers.  Fixtures are in the conftest files, which nobody imports."""

import os
from datetime import date, datetime, timedelta

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def days(start: str, n: int) -> list[date]:
    return [date.fromisoformat(start) + timedelta(days=i) for i in range(n)]


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def steady(rows):
    """Rows in a fixed order with numbers cut to nine digits: sums may differ in the last bits between plans."""
    def cut(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(cut(v) for v in r) for r in rows), key=repr)
