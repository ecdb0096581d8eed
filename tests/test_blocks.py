"""Hand-written logs of test tools and documents, all readers on: owner, name, place, message and evidence of every failure."""

import pytest

from breakweave.plans import report

PYTEST_TWINS = """=================================== FAILURES ===================================
__________________________________ test_total __________________________________

    def test_total():
>       assert total() == 3
E       assert 4 == 3

tests/test_a.py:11: AssertionError
__________________________________ test_total __________________________________

    def test_total():
>       raise KeyError("rate")
E       KeyError: 'rate'

shop/rates.py:5: KeyError
_________________________ TestCart.test_sum[1 - 2] _________________________
tests/test_b.py:30: in test_sum
    check()
tests/helpers.py:8: in check
    raise ValueError("no")
E   ValueError: no
=========================== short test summary info ============================
FAILED tests/test_a.py::test_total - assert 4 == 3
FAILED tests/test_b.py::test_total - KeyError: 'rate'
FAILED tests/test_c.py::test_alone - OSError: gone
3 failed in 0.1s
"""
PYTEST_COLLECT = """==================================== ERRORS ====================================
_______________________ ERROR collecting test_broken.py ________________________
ImportError while importing test module '/w/test_broken.py'.
Traceback:
test_broken.py:1: in <module>
    import nothing
E   ModuleNotFoundError: No module named 'nothing'
=========================== short test summary info ============================
ERROR test_broken.py
1 error in 0.05s
"""
PYTEST_NATIVE = """=================================== FAILURES ===================================
__________________________________ test_total __________________________________
Traceback (most recent call last):
  File "/w/tests/test_a.py", line 4, in test_total
    total()
  File "/w/shop/cart.py", line 9, in total
    raise ValueError("bad rate")
ValueError: bad rate
=========================== short test summary info ============================
FAILED tests/test_a.py::test_total - ValueError: bad rate
"""
GO_VERBOSE = """=== RUN   TestA
=== PAUSE TestA
=== RUN   TestB
=== PAUSE TestB
=== CONT  TestA
    a_test.go:10: first of A
=== CONT  TestB
    b_test.go:20: only of B
=== NAME  TestA
    a_test.go:12: second of A
--- FAIL: TestB (0.01s)
--- FAIL: TestA (0.02s)
=== RUN   TestC
--- FAIL: TestC (0.00s)
panic: boom [recovered]
\tpanic: boom
goroutine 7 [running]:
testing.tRunner.func1.2({0x1, 0x2})
\t/usr/local/go/src/testing/testing.go:1632 +0x230
shop.TestC(0xc0)
\t/w/c_test.go:33 +0x1d
FAIL\tshop\t0.004s
FAIL
"""
GO_JSON = "\n".join([
    "go: downloading example.com/x v1.0.0",
    '{"Time":"2024-01-01T00:00:00Z","Action":"run","Package":"p/one","Test":"TestX"}',
    '{"Action":"run","Package":"p/two","Test":"TestX"}',
    '{"Action":"output","Package":"p/one","Test":"TestX","Output":"    one_test.go:5: of \\"one\\"\\n"}',
    '{"Action":"output","Package":"p/two","Test":"TestX","Output":"    two_test.go:6: of two\\n"}',
    '{"Action":"output","Package":"p/one","Test":"TestX","Output":"--- FAIL: TestX (0.00s)\\n"}',
    '{"Action":"fail","Package":"p/two","Test":"TestX","Elapsed":0}',
    '{"Action":"fail","Package":"p/one","Test":"TestX","Elapsed":0}',
    '{"Action":"pass","Package":"p/one","Test":"TestOk","Elapsed":0}',
    '{"Action":"fail","Package":"p/one","Elapsed":0.1}',
    '{"ImportPath":"p/three","Action":"build-output","Output":"./three.go:3:7: undefined: y\\n"}',
])
MOCHA_NESTED = """
  Cart
    1) adds
    ✔ is empty

  1 passing (4ms)
  2 failing

  1) Cart
       when full
         adds:
     TypeError: Cannot read properties of undefined (reading 'n')
      at total (/w/src/cart.js:4:9)
      at Context.<anonymous> (/w/test/cart.spec.js:8:3)

  2) Rates
       "before all" hook:
     Error: Timeout of 2000ms exceeded.
      at listOnTimeout (node:internal/timers:594:17)
"""
VITEST = """ FAIL  |unit| src/a.test.ts > a > one
AssertionError: expected 4 to be 3 // Object.is equality
 ❯ node_modules/chai/index.js:3:1
 ❯ Module.total src/cart.ts:7:11

 FAIL  src/b.test.ts > two
Error: Test timed out in 5000ms.
 ❯ src/b.test.ts:2:3

 Test Files  2 failed (2)
"""
TWO_DOCUMENTS = """[INFO] linting { started
[{"filePath":"a.js","messages":[{"ruleId":"no-x","severity":2,"line":3,"column":4,"message":"bad"}]}]
[WARN] again
[
  {
    "filePath": "b.js",
    "messages": [
      {"ruleId": "no-y", "severity": 2, "line": 5, "column": 6, "message": "brackets ] } \\" in text"}
    ]
  }
]
Done.
"""
OPEN_DOCUMENT = """{
  "level": "started",
{
  "generalDiagnostics": [
    {"file": "a.py", "severity": "error", "message": "no", "rule": "r", "range": {"start": {"line": 1, "character": 2}}}
  ],
  "summary": {"errorCount": 1}
}
"""
CASES = {
    "pytest twins": (PYTEST_TWINS, "pytest", [
        ("test_total", "tests/test_a.py", 11, "assert 4 == 3", 2), ("test_total", "shop/rates.py", 5, "KeyError: 'rate'", 9), ("TestCart.test_sum[1 - 2]", "tests/helpers.py", 8, "ValueError: no", 16), ("test_alone", "tests/test_c.py", None, "OSError: gone", 25),
    ]),
    "pytest collect": (PYTEST_COLLECT, "pytest", [("test_broken.py", "test_broken.py", 1, "ModuleNotFoundError: No module named 'nothing'", 2)]),
    "pytest native": (PYTEST_NATIVE, "pytest", [("test_total", "/w/shop/cart.py", 9, "ValueError: bad rate", 2)]),
    "go verbose": (GO_VERBOSE, "go test", [("TestA", "a_test.go", 10, "first of A\nsecond of A", 6), ("TestB", "b_test.go", 20, "only of B", 8), ("TestC", "/w/c_test.go", 33, "panic: boom", 14)]),
    "go json": (GO_JSON, "go test", [("TestX", "two_test.go", 6, "of two", 5), ("TestX", "one_test.go", 5, 'of "one"', 4), (None, "three.go", 3, "undefined: y", 11)]),
    "mocha nested": (MOCHA_NESTED, "mocha", [("Cart when full adds", "/w/src/cart.js", 4, "TypeError: Cannot read properties of undefined (reading 'n')", 9), ('Rates "before all" hook', None, None, "Error: Timeout of 2000ms exceeded.", 16)]),
    "vitest": (VITEST, "vitest", [("a > one", "src/cart.ts", 7, "AssertionError: expected 4 to be 3 // Object.is equality", 1), ("two", "src/b.test.ts", 2, "Error: Test timed out in 5000ms.", 6)]),
    "two documents": (TWO_DOCUMENTS, "eslint", [(None, "a.js", 3, "bad", 2), (None, "b.js", 5, 'brackets ] } " in text', 4)]),
    "open document": (OPEN_DOCUMENT, "pyright", [(None, "a.py", 2, "no", 3)]),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, raw, None) for name, (raw, _, _) in CASES.items()]
    # in blocks that are long, and the same log behind a CI stamp
    rows += [("stamped", "\n".join(f"2024-01-01T00:00:00.1Z {x}" for x in VITEST.split("\n")), None)]
    logs = spark.createDataFrame(rows, "log_id string, raw string, argv array<string>")
    out = {}
    for r in report.analysed(logs).where("role = 'own'").orderBy("log_id", "reader", "ord").collect():
        out.setdefault(r.log_id, []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_failures_of_the_log(read, name):
    _, tool, want = CASES[name]
    got = read[name]
    assert {r.tool for r in got} == {tool}
    assert sorted(((r.subject, r.file, r.line, r.message, r.places[0].start) for r in got), key=str) == sorted(want, key=str)


def test_evidence_covers_documents_and_blocks(read):
    assert [(p.start, p.end) for r in read["two documents"] for p in r.places] == [(2, 2), (4, 11)]
    assert [(r.places[0].start, r.places[0].end) for r in read["vitest"]] == [(1, 4), (6, 8)]
    assert [(r.file, r.line) for r in read["stamped"]] == [("src/cart.ts", 7), ("src/b.test.ts", 2)]


def test_many_blocks_and_documents_in_linear_time(spark):
    many = "\n".join(f"=== RUN   T{i}\n    a_test.go:{i + 1}: bad {i}\n--- FAIL: T{i} (0.00s)" for i in range(5000))
    open_ones = "{\n" * 20000
    logs = spark.createDataFrame([("1", many, None), ("2", open_ones, None)], "log_id string, raw string, argv array<string>")
    got = report.analysed(logs).where("role = 'own'").collect()
    assert len(got) == 5000 and {r.line for r in got} == set(range(1, 5001))
