"""Sale assembly against a plain loop over batches and days."""

import math
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from lexweave.llm import assembly

EPOCH = datetime(1970, 1, 1)
SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def plainly(sales, lines, batches=8):
    crc = lambda s: zlib.crc32(s.encode())
    cents = lambda x: 0 if x is None else math.floor(100 * x + 0.5)
    rows, own = defaultdict(list), defaultdict(list)
    for r in {tuple(r) for r in lines if r.sale_id is not None}:
        sale, line, amount, shipped = r[0], r[1], r[5], r[8]
        h = crc(f"{sale}:{'' if line is None else line}")
        d = 19723 + h % 152 if shipped is None else (shipped - EPOCH).days + h % 8
        own[sale].append((d, cents(amount)))
        rows[d].append((sale, None, 1, cents(amount)))
    for r in sales:
        if r.sale_id is not None:
            d = 19723 if r.arrived_at is None else (r.arrived_at - EPOCH).days
            kind, mine = crc(str(r.sale_id)) % 5, own[r.sale_id]
            last = max((x for x, _ in mine), default=0)
            due = cents(r.total) if kind == 0 else sum(c for x, c in mine if kind != 1 or x < last)
            rows[d].append((r.sale_id, due, 0, 0))
    cut = defaultdict(list)
    for d in rows:
        cut[min(batches - 1, max(0, math.floor((d - 19723) * batches / 160)))].append(d)
    out, open_, mark = [], {}, None
    for b in range(batches):
        for d in sorted(cut[b]):
            for sale in sorted({r[0] for r in rows[d]}):
                a = open_.setdefault(sale, {"first": d, "lines": 0, "cents": 0, "due": None})
                a["last"] = d
                for _, due, n, c in (r for r in rows[d] if r[0] == sale):
                    a["lines"] += n
                    a["cents"] += c
                    a["due"] = a["due"] if due is None else due
                if a["due"] is not None and a["lines"] and a["cents"] == a["due"]:
                    out.append((sale, a["first"], d, a["lines"], a["cents"], a["due"], "complete", b))
                    del open_[sale]
        for sale, a in list(open_.items()):
            if b == batches - 1 or mark is not None and a["first"] + 5 <= mark:
                status = "headless" if a["due"] is None else "orphan" if not a["lines"] else "short" if a["cents"] < a["due"] else "over"
                out.append((sale, a["first"], a["last"], a["lines"], a["cents"], a["due"], status, b))
                del open_[sale]
        mark = max([*cut[b], *([mark] if mark is not None else [])], default=None)
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("per_sale", [False, True])
def test_small_shop_equals_plain_loop(spark, per_sale):
    at = lambda day: EPOCH + timedelta(days=19723 + day, hours=7)
    sale = lambda i, total, day: (i, 1, "done", total, None, None if day is None else at(day), 1)
    line = lambda i, no, amount, day, flag="kept": (i, no, 1, 1, 1, amount, 0.0, flag, None if day is None else at(day))
    sales = [sale(i, 10.0 + i, (7 * i) % 150) for i in range(40)] + [sale(50, None, 3), sale(51, 0.0, None), sale(None, 1.0, 1), sale(52, 5.0, 400)]
    lines = [line(i % 45, no, 1.25 * no + i, (7 * (i % 45) + 3 * no) % 155) for i in range(60) for no in (1, 2, 3)]
    lines += [line(3, 1, 2.0, 9), line(3, 1, 2.0, 9), line(3, 1, 2.0, 9, "swapped"), line(4, None, None, None), line(None, 1, 1.0, 2), line(60, 9, 0.005, -30), line(60, 10, 1e9, 700)]
    sales, lines = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    found = assembly.assemble(sales, lines, per_sale=per_sale)
    assert ordered(found.collect()) == ordered(plainly(sales.collect(), lines.collect()))


def test_whole_tables_equal_plain_loop(spark, sf_dir, monkeypatch):
    sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines"))
    monkeypatch.setattr(assembly, "KEY_ROWS", 512)  # several keys
    found = assembly.assemble(sales, lines)
    expected = plainly(sales.collect(), lines.collect())
    assert ordered(found.collect()) == ordered(expected)
    assert {r[6] for r in expected} == {"complete", "headless", "orphan", "short", "over"}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_gaps_between_batches_and_no_rows(spark):
    """Batches 1 to 6 are empty: what is open closes after batch 1, by the days of batch 0."""
    line = (1, 1, 1, 1, 1, 1.0, 0.0, "kept", EPOCH + timedelta(days=19723))
    late = (2, 1, 1, 1, 1, 1.0, 0.0, "kept", EPOCH + timedelta(days=19732))
    lines, none = spark.createDataFrame([line, late], LINES), spark.createDataFrame([], SALES)
    found = assembly.assemble(none, lines)
    assert ordered(found.collect()) == ordered(plainly([], lines.collect())) and {r.closing_batch for r in found.collect()} == {1, 7}
    assert assembly.assemble(none, lines.limit(0)).count() == 0
