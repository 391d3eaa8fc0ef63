"""Run only the checking SQL, to catch mistakes without starting Spark."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check_queries import duck  # noqa: E402
from tidemark.catalog import REGISTRY  # noqa: E402

con = duck(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
for name, q in REGISTRY.items():
    if q.sql is None or (len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:])):
        continue
    t = time.time()
    try:
        cur = con.execute(q.sql)
        kinds = {d[0]: str(d[1]) for d in cur.description}
        odd = {n: k for n, k in kinds.items() if k.startswith("DECIMAL") or k in ("HUGEINT", "UBIGINT") or "[" in k or "(" in k}
        rows = len(cur.fetchall())
        flag = "EMPTY" if rows == 0 else "ok"
        print(f"{flag} {name} rows={rows} {time.time() - t:.2f}s {odd or ''}")
    except Exception as exc:  # noqa: BLE001
        print(f"ERR {name} {str(exc)[:600]}")
