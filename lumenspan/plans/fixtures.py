"""Small literal inputs for queries on code, diffs and reports, which the driver's tables don't hold."""

from __future__ import annotations

DIFF = """diff --git a/jobs/load_feature.py b/jobs/load_feature.py
index 1..2 100644
--- a/jobs/load_feature.py
+++ b/jobs/load_feature.py
@@ -1,5 +1,6 @@
 import pickle
-age: int = 0
-old_metric: float = 0.0
+age: float = 0.0
+new_score: float = 1.0
+api_key = "abcdefgh12345678"
 df["total"]
--- not a header
+++ not a header either
@@ -20,2 +21,3 @@ def run():
     x = 1
+    data = pickle.loads(raw)
     return x
diff --git a/db/schema.sql b/db/schema.sql
--- a/db/schema.sql
+++ b/db/schema.sql
@@ -1,4 +1,6 @@
 CREATE TABLE users (
     id BIGINT,
-    name VARCHAR(10),
+    full_name VARCHAR(99),
+    born DATE,
 );
+ALTER TABLE orders DROP COLUMN note;
diff --git a/app/models.py b/app/models.py
new file mode 100644
--- /dev/null
+++ b/app/models.py
@@ -0,0 +1,9 @@
+class User(BaseModel):
+    email: str
+    tags: list[str]
+
+@dataclass
+class Point:
+    left: int
+
+LIMIT = 3
diff --git a/jobs/nightly.yml b/jobs/nightly.yml
--- a/jobs/nightly.yml
+++ b/jobs/nightly.yml
@@ -1,6 +1,8 @@
 name: nightly
-  quartz_cron_expression: "0 0 1 * * ?"
+  quartz_cron_expression: "0 0 2 * * ?"
 tasks:
   - task_key: extract
-    num_workers: 2
+    num_workers: 4
+    fail_on_run_failure: false
+  - task_key: publish
"""

BASE = '''import os


def kept(a, b=1):
    return a + b


async def fetch(url: str) -> Optional[str]:
    return await get(url)


def old_name(x):
    return x * 2 + 40


class Store(Base):
    def save(self, row):
        return self.put(row)


def gone():
    pass
'''

HEAD = '''import os


def kept(a, b=1):
    return a + b + 0


@cached
def fetch(url: str, timeout: int) -> str:
    return get(url)


def new_name(x):
    return x * 2 + 40


class Store(Base):
    def save(self, row):
        return self.put(row)

    def load(self, key):
        return kept(key)
'''

NIGHTLY = """name: nightly
schedule:
  quartz_cron_expression: "0 0 2 * * ?"
tasks:
  - task_key: extract
    notebook_path: "/jobs/extract"
    num_workers: 4
    fail_on_run_failure: false
  - task_key: publish
    depends_on:
      - task_key: extract
    node_type_id: small
"""

REPORT_JOB = """name: report
tasks:
  - task_key: render
    depends_on:
      - task_key: publish
  - task_key: mail
    job_name: nightly
"""

SQL_FILE = """CREATE OR REPLACE TABLE mart.sales AS
SELECT * FROM raw.orders o JOIN raw.customers c ON o.id = c.id;
INSERT INTO mart.audit SELECT 1;
DROP TABLE IF EXISTS old_sales;
"""

SPARK_FILE = '''df = spark.read.table("raw.orders")
spark.sql("SELECT * FROM mart.sales JOIN " "x")
out = spark.sql("""SELECT a FROM mart.sales
JOIN mart.audit ON true""")
out.write.saveAsTable("mart.report")
'''

YAML_FILE = "source_table: raw.orders\ntarget_table: mart.report\n"

REVIEW = """---
repo: acme/shop
pr: {pr}
title: Change {pr}
date: 2024-05-0{day} 10:00 UTC
cost_usd: 0.{day}
requested_by: ann
---
## Code Review

**Review:** {verdict} &nbsp;·&nbsp; **Risk:** `{risk}`

### Summary
Text
```
### not a heading
```
### Files
- a.py
- b.py
"""

FILES = (
    ("app/service.py", BASE),
    ("app/orphan.py", "def lonely():\n    return 1\n"),
    ("tests/test_service.py", "import pytest\n\nfrom app.service import kept, fetch\n\n\ndef test_kept():\n    assert kept(1) == 2\n"),
    ("web/index.ts", "import React, { useState } from 'react';\nexport function App() { const inner = run(); return draw(inner); }\nconst limit = 3; // call(me)\nclass Box {}\n"),
    ("models/orders.sql", "select * from {{ ref('stg_orders') }} join {{ source('shop', 'users') }} on true\n"),
    ("models/schema.yml", "models:\n  - name: orders\n    columns:\n      - name: id\nsources:\n  - name: shop\n    tables:\n      - name: users\n"),
    ("etl/sales.sql", SQL_FILE),
    ("etl/report.py", SPARK_FILE),
    ("conf/tables.yml", YAML_FILE),
    ("jobs/nightly.yml", NIGHTLY),
    ("jobs/report.yml", REPORT_JOB),
    ("Dockerfile", "FROM scratch\n"),
    ("README.md", "# shop\n"),
    ("ci/deploy.yml", "on_failure:\n  - ann@example.org\nfail_on_run_failure: false\n"),
    ("lib/bad.py", "x = row.id.cast('int')\ntry:\n    run()\nexcept:\n    pass\npassword = 'hunter2hunter2'\n"),
)

COMMENTS = (
    ("r1", 1, "a.sql", "3", "critical", "data", "Uses CREATE OR REPLACE TABLE on PROD.SALES.ORDERS which loses grants", "Alter it"),
    ("r1", 2, "b.sql", None, "Critical", "data", "A create or replace table here drops history", ""),
    ("r1", 3, "c.py", "9", "high", "style", "The function name is not clear enough to a reader", None),
    ("r1", 4, "d.py", "1", "high", "style", "The function name is not clear enough for a reader", "x"),
    ("r1", 5, "e.py", "1", "low", "style", "The function name is not clear enough to a reader", None),
    ("r2", 1, "a.py", "1", "high", "style", "Something else entirely", None),
)
