"""Hand-written diffs of formatters: places of hunks, diffs of others, odd bodies."""

from breakweave.operators import parsing
from breakweave.operators.readers import READERS

MINE = tuple(r for r in READERS if r.name in ("gofmt", "terraform fmt"))
GO = """diff cart/a.go.orig cart/a.go
--- cart/a.go.orig
+++ cart/a.go
@@ -2,7 +2,7 @@

 import "fmt"
 
-func total( a int ) int {
+func total(a int) int {
 	return a
@@ -20,3 +20,4 @@
 	b()
+	c()
 }
@@ -20,3 +20,4 @@
-	again
@@ -60 +60 @@
-	one line
"""
LOGS = {
    # the blank line of the first hunk has lost its space, so it ends the body: the hunk says nothing, and is placed where it begins
    "blank context": GO,
    "go": GO.replace("@@\n\n", "@@\n \n"),
    # a test suite's diff after the formatter's
    "other diff": GO.split("@@ -20", 1)[0].replace("@@\n\n", "@@\n \n") + "--- expected\n+++ actual\n@@ -9,1 +9,1 @@\n-3\n+4\n",
    "two files": "diff a.go.orig a.go\n--- a.go.orig\n+++ a.go\n@@ -1,2 +1,2 @@\n-a\n+b\ndiff b.go.orig b.go\n--- b.go.orig\n+++ b.go\n@@ -1,2 +1,2 @@\n+x\n+y\n-a\n",
    "far": "--- old/m.tf\n+++ new/m.tf\n@@ -5,2 +5,2 @@\n a\n b\n-c\n@@ -9,2 +9,2 @@\n-d\n+e\n",
    "bare": "diff a.go.orig a.go\n",
    "no header": "@@ -1,2 +1,2 @@\n-a\n+b\n.orig diff ",
    "empty": "", "null": None,
}


def test_places_of_hunks(spark):
    logs = spark.createDataFrame(list(LOGS.items()), "log_id string, raw string")
    got = {}
    for r in parsing.parsed(logs, MINE).orderBy("log_id", "ord").collect():
        got.setdefault(r.log_id, []).append((r.file, r.line, [tuple(p) for p in r.places]))
    assert got["go"] == [("cart/a.go", 5, [(1, 10)]), ("cart/a.go", 21, [(1, 14)]), ("cart/a.go", 60, [(1, 18)])]
    assert [x[:2] for x in got["blank context"]] == [("cart/a.go", 2), ("cart/a.go", 21), ("cart/a.go", 60)]
    assert [x[:2] for x in got["other diff"]] == [("cart/a.go", 5)]
    assert got["two files"] == [("a.go", 1, [(1, 6)]), ("b.go", 1, [(7, 13)])]
    assert [x[:2] for x in got["far"]] == [("m.tf", 9)]
    assert got["bare"] == [("a.go", None, [(1, 1)])]
    assert not {"no header", "empty", "null"} & set(got)
