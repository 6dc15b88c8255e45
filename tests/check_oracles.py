"""Run every registered query against its oracle: python tests/check_oracles.py [sf_dir] [names...]"""

import json
import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

from harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from labelforge.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_session()
con = duck(sf)
qs, os_ = E.queries(), E.oracle_sql()
bad = 0
for n, fn in qs.items():
    if names and not any(n.startswith(x) for x in names):
        continue
    t = time.time()
    try:
        if n in os_:
            r = compare(spark, con, n, fn, os_[n], sf)
        else:
            r = {"name": n, "spark_rows": fn(spark, sf).count(), "oracle": None}
    except Exception as e:  # noqa: BLE001
        r = {"name": n, "error": repr(e)[:800]}
    r["sec"] = round(time.time() - t, 2)
    ok = r.get("hash_match", "error" not in r and r.get("oracle", 1) is None)
    bad += not ok
    print(("OK  " if ok else "BAD ") + json.dumps(r, default=str)[:1500], flush=True)
print("failures:", bad)
