"""The grammars of tool output, each a few line patterns over the tool's public text format.

A reader is asked only for logs that hold one of its signals. Its main pattern finds a diagnostic in one line. Where the tool puts a
file above its rows, heading finds it; where the place stands on a line of its own, at finds it within reach lines after the diagnostic (reach > 0) or
before it (reach < 0). alts are the tool's further text formats, each a pattern and its groups. Groups are named in the order of the pattern's groups. The order of the list is the precedence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FIELDS = ("file", "line", "col", "severity", "code", "subject", "label", "message")


@dataclass(frozen=True)
class Block:
    """Lines that belong together: the reader's pattern (or opens, where the pattern reads a summary line) opens a block, its at names places.

    closes: a line that ends a block; region: a line after which alone blocks count; says: a line of the message, of which the first most are kept; stop: a line after which nothing is said;
    spare: a line that is the message where nothing else is; names: lines right below the opening that go on with the name; keys: lines that name the test which the next ones belong to.
    hunks: instead of all this, the pattern heads a diff whose hunks are places, and lines that hunks finds begin someone else's.
    last: the last place counts, not the first; needs: a block that says nothing and names no place is none; events: lines are test2json events.
    """

    opens: str = ""
    opens_groups: tuple[str, ...] = ("subject",)
    closes: str = ""
    region: str = ""
    says: str = ""
    most: int = 4
    stop: str = ""
    spare: str = ""
    names: str = ""
    keys: str = ""
    hunks: str = ""
    last: bool = False
    needs: bool = False
    events: bool = False


@dataclass(frozen=True)
class Reader:
    name: str
    category: str
    signals: tuple[str, ...]
    pattern: str
    groups: tuple[str, ...]
    heading: str = ""
    at: str = ""
    at_groups: tuple[str, ...] = ("file", "line", "col")
    reach: int = 0
    constants: dict = field(default_factory=dict)
    commands: tuple[str, ...] = ()
    alts: tuple[tuple[str, str], ...] = ()
    errors: tuple[str, ...] = ("error", "fatal", "e", "f", "failure", "")
    sample: tuple[str, ...] = ()
    block: Block | None = None

    @property
    def tool(self) -> str:
        return self.constants.get("tool", self.name)


def _r(name, category, signals, pattern, groups, sample, **more):
    return Reader(name, category, tuple(signals), pattern, tuple(groups.split()), sample=tuple(sample), **more)


LOC = r"([^\s:()'\"]+):(\d+):(\d+)"
#: sample lines use {file} {line} {col} {code} {message} {subject}
READERS = (
    _r("pytest", "test", ["FAILED ", "short test summary"], r"^(?:FAILED|ERROR) ([^\s:]+)::(\S+) - (.+)$", "file subject message", ["FAILED {file}::{subject} - {message}"], commands=("pytest", "py.test"),
       alts=((r"^(?:FAILED|ERROR) ([^\s:]+)::(\S+)$", "file subject"), (r"^ERROR ([^\s:]+\.py)(?: - (.+))?$", "file message")), at=r'^(?:  File ")?([^\s"(].*?)(?:", line |:)(\d+)(?:, in .*|:\s*(?:in \S+|\w[\w.]*)?\s*)$', at_groups=("file", "line"),
       block=Block(opens=r"^_{3,}\s+(.+?)\s+_{3,}$", closes=r"^=+ .* =+$", says=r"^E\s+(.*?)\s*$", most=40, spare=r"^((?:\w+\.)*\w*(?:Error|Exception|Exit|Interrupt|Warning|Failed)\b.*)$", last=True)),
    _r("node --test", "test", ["failureType:", "# Subtest: ", "duration_ms"], r"^\s*not ok \d+ - (.+)$", "subject", ["not ok 1 - {subject}", "  duration_ms: 1.5", "  location: '{file}:{line}:{col}'"], at=r"^\s+location: '([^']+):(\d+):(\d+)'", reach=6, constants={"message": "test failed"}, commands=("node",)),
    _r("bun test", "test", ["bun test v", "(fail) "], r"^\(fail\) (.+?)(?: \[[\d.]+ms\])?$", "subject", ["error: {message}", "      at <anonymous> ({file}:{line}:{col})", "(fail) {subject}"], at=r"^\s+at .*\(([^()\s:]+):(\d+):(\d+)\)", reach=-20, constants={"message": "test failed"}, commands=("bun",)),
    _r("bun", "runtime", ["Bun v"], r"^(?:error|(\w*Error)): (.+)$", "code message", ["error: {message}", "      at {file}:{line}:{col}", "Bun v1.1.0 (linux)"], at=r"^\s+at (?:.* \()?([^()\s:]+):(\d+):(\d+)\)?", reach=6, commands=("bun",)),
    _r("deno test", "test", [" ERRORS ", "... FAILED"], r"^(.+?) => ([^\s:]+):(\d+):(\d+)$", "subject file line col", [" ERRORS ", "{subject} => {file}:{line}:{col}"], constants={"message": "test failed"}, commands=("deno",)),
    _r("deno", "runtime", ["error: Uncaught"], r"^error: Uncaught \((?:in promise\) \()?(\w+)\)?:? (.+)$", "code message", ["error: Uncaught (TypeError) {message}", "    at file:///{file}:{line}:{col}"], at=r"^\s+at (?:.* \()?file:///([^\s:]+):(\d+):(\d+)\)?", reach=8, commands=("deno",)),
    _r("deno lint", "lint", ["(no-", "error[", "deno lint"], r"^" + LOC + r": (.+) \((no-[\w-]+)\)$", "file line col message code", ["deno lint", "{file}:{line}:{col}: {message} (no-{subject})"], commands=("deno",)),
    _r("deno fmt", "lint", ["deno fmt", "not formatted"], r"^from (\S+):$", "file", ["deno fmt", "from {file}:", "error: Found 1 not formatted file"], constants={"label": "format", "message": "not formatted"}),
    _r("playwright", "test", [" › "], r"^\s+\d+\) (?:\[\w+\] › )?([^\s:]+):(\d+):(\d+) › (.+?)\s*─*$", "file line col subject", ["  1) [chromium] › {file}:{line}:{col} › {subject} "], constants={"message": "test failed"}, commands=("playwright",)),
    _r("jest", "test", ["FAIL "], r"^\s*● (.+?)\s*$", "subject", ["FAIL {file}", "  ● {subject}", "      at Object.<anonymous> ({file}:{line}:{col})"], heading=r"^\s*(?:FAIL|PASS) (?:\S+ )*?(?:\./)?([^\s()]+)(?: \([\d.]+ m?s\))?\s*$", at=r"^\s+at (?:.*\()?([^()\s:]+):(\d+):(\d+)\)?$",
       block=Block(closes=r"^(?:\s*● (?:Console|Validation Warning|Deprecation Warning)|Test Suites:|Summary of all failing tests|::[a-z][\w-]*.*::)", says=r"^\s*+(?!\d+\s*\||>\s*\d+\s*\||\||\^+\s*$|at |[-+]\s*(?:Snapshot|Received|Expected)\s+[-+]\s*\d|@@ |Snapshot name:)(\S.*?)\s*$", most=3, last=True),
       constants={"message": "test failed"}, commands=("jest",)),
    _r("mocha", "test", [" failing"], r"^  \d+\) (.+)$", "subject", ["  1 failing", "  1) {subject}", "      at Context.<anonymous> ({file}:{line}:{col})"], at=r"^\s+at (?:.*\()?([^()\s:]+):(\d+):(\d+)\)?$",
       block=Block(region=r"^\s*\d+ failing\b", names=r"^ {7,}(?!at |[-+] ?)(\S.*?)\s*$", says=r"^\s*+(?!\+ expected - actual|at )(\S.*?)\s*$", stop=r"^\s+at "), constants={"message": "test failed"}, commands=("mocha",)),
    _r("ava", "test", ["tests failed", "test failed"], r"^  ✘ \[fail\]: (.+)$", "subject", ["  ✘ [fail]: {subject}", "  {file}:{line}", "  1 test failed"], at=r"^  ([^\s:]+):(\d+)$", at_groups=("file", "line"), reach=12, constants={"message": "test failed"}, commands=("ava",)),
    _r("jasmine", "test", ["Jasmine", "Randomized with seed", "jasmine"], r"^\d+\) (.+)$", "subject", ["Failures:", "1) {subject}", "        at <Jasmine>", "        at UserContext.<anonymous> ({file}:{line}:{col})"], at=r"^\s+at .*\(([^()\s:]+):(\d+):(\d+)\)", reach=20, constants={"message": "test failed"}, commands=("jasmine",)),
    _r("rubocop", "lint", [": C: ", ": W: ", ": E: ", ": F: "], r"^" + LOC + r": ([CWEFR]): (?:\[Correctable\] )?([A-Z]\w+/\w+): (.+)$", "file line col severity code message", ["{file}:{line}:{col}: E: Lint/{code}: {message}"], errors=("e", "f", "c", "w", "r", "i"), commands=("rubocop",)),
    _r("tap", "test", ["TAP version"], r"^not ok \d+ - (.+)$", "subject", ["TAP version 14", "not ok 1 - {subject}", "  at:", "    {file}:{line}"], at=r"^\s+([^\s:]+):(\d+)$", at_groups=("file", "line"), reach=12, constants={"message": "test failed"}),
    _r("tap-text", "test", ["not ok "], r"^not ok \d+ - (.+)$", "subject", ["1..1", "not ok 1 - {subject}"], constants={"message": "test failed"}),
    _r("vitest", "test", [" FAIL  "], r"^\s*FAIL\s+(?:\|[^|]+\|\s+)?(\S+) > (.+?)\s*$", "file subject", [" FAIL  {file} > {subject}", " ❯ {file}:{line}:{col}"], at=r"^\s*❯ (?:.* )?([^\s:]+):(\d+):(\d+)$",
       block=Block(closes=r"^\s*(?:Test Files|⎯[⎯ ]*(?:Failed|Unhandled)\b.*⎯)", says=r"^\s*+(?!❯|⎯|[-+] (?:Expected|Received)\b|\d+\s*\||\||\^)(\S.*?)\s*$", most=5, stop=r"^\s*❯"), constants={"message": "test failed"}, commands=("vitest",)),
    _r("unittest", "test", ["FAIL: ", "ERROR: "], r"^(?:FAIL|ERROR): (\w+) \([\w.]+\)$", "subject", ["FAIL: {subject} (pkg.Case)", '  File "{file}", line {line}, in {subject}', "AssertionError: {message}"], at=r'^  File "([^"]+)", line (\d+)', at_groups=("file", "line"), reach=12, constants={"message": "test failed"}, commands=("unittest",)),
    _r("python", "runtime", ["Traceback (most recent call last)"], r"^((?:\w+\.)*\w*(?:Error|Exception|Interrupt|Exit|Warning)): (.*)$", "code message", ["Traceback (most recent call last):", '  File "{file}", line {line}, in f', "{code}Error: {message}"], at=r'^  File "([^"]+)", line (\d+)', at_groups=("file", "line"), reach=-12, commands=("python", "python3")),
    _r("eslint", "lint", [" problem", " error ", ", Error - "], r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s{2,}(\S+)$", "line col severity message code", ["{file}", "  {line}:{col}  error  {message}  rule-{code}", "1 problem"], heading=r"^((?:[A-Za-z]:)?[\w./\\@-]+\.(?:[cm]?[jt]sx?|vue|svelte))$", alts=((r"^(\S+): line (\d+), col (\d+), (Error|Warning) - (.+) \((\S+)\)$", "file line col severity message code"),), commands=("eslint",)),
    _r("ruff", "lint", ["ruff", "Found "], r"^" + LOC + r": ([A-Z]{1,4}\d{3,4}) (?:\[\*\] )?(.+)$", "file line col code message", ["{file}:{line}:{col}: F{line}00 {message}", "Found 1 error. ruff"], alts=((r"^([A-Z]{1,4}\d{3,4}|invalid-syntax):? (?:\[\*\] )?(.+)$", "code message"), (r"^::error title=ruff \((\w+)\),file=([^,]+),line=(\d+),col=(\d+),.*?::\S+ (.+)$", "code file line col message")),
       at=r"^\s+--> ([^\s:]+):(\d+):(\d+)$", reach=2, commands=("ruff",)),
    _r("pylint", "lint", ["(", "************* Module"], r"^" + LOC + r": ([EFCRW]\d{4}): (.+) \([\w-]+\)$", "file line col code message", ["************* Module m", "{file}:{line}:{col}: E{line}000: {message} (sym-{subject})"], commands=("pylint",)),
    _r("flake8", "lint", [], r"^" + LOC + r": ([A-Z]{1,3}\d{3}) (.+)$", "file line col code message", ["{file}:{line}:{col}: E{line}00 {message}"], commands=("flake8",)),
    _r("golangci-lint", "lint", ["("], r"^([^\s:()]+\.go):(\d+):(\d+): (.+) \((\w+)\)$", "file line col message code", ["{file}.go:{line}:{col}: {message} ({code})"], commands=("golangci-lint",)),
    _r("markdownlint", "lint", [" MD"], r"^([^\s:]+):(\d+)(?::(\d+))? (?:error )?(MD\d{3})/[\w/-]+ (.+)$", "file line col code message", ["{file}.md:{line}:{col} MD00{line}/rule-{code} {message}"], commands=("markdownlint",)),
    _r("stylelint", "lint", ["✖", "×"], r"^\s+(\d+):(\d+)\s+[✖×]\s+(.+?)\s{2,}(\S+)$", "line col message code", ["{file}.css", "  {line}:{col}  ✖  {message}  rule-{code}"], heading=r"^(\S+\.(?:css|scss|less|sass))$", commands=("stylelint",)),
    _r("shellcheck", "lint", ["[SC", "(error):", "(warning):", "shellcheck"], r"^" + LOC + r": (error|warning|note): (.+) \[(SC\d+)\]$", "file line col severity message code", ["{file}:{line}:{col}: error: {message} [SC{line}]"], alts=((r"^\s*\^-*\^? (SC\d+) \((error|warning)\): (.+)$", "code severity message"),),
       at=r"^In (\S+) line (\d+):$", at_groups=("file", "line"), reach=-8, errors=("error", "warning"), commands=("shellcheck",)),
    _r("yamllint", "lint", ["[error]", "[warning]"], r"^" + LOC + r": \[(error|warning)\] (.+?)(?: \(([\w-]+)\))?$", "file line col severity message code", ["{file}:{line}:{col}: [error] {message} ({code})"], commands=("yamllint",)),
    _r("biome", "lint", ["lint/", "biome"], r"^([^\s:]+):(\d+):(\d+) (lint/\w+/\w+|parse|format)\b.*$", "file line col code", ["{file}:{line}:{col} lint/style/{code} ━━━"], constants={"message": "lint"}, commands=("biome",)),
    _r("oxlint", "lint", ["[Error/", "oxlint", "oxc.rs", " rules using ", "eslint(", "typescript(", "unicorn("], r"^" + LOC + r": (.+) \[(Error|Warning)/([\w()/-]+)\]$", "file line col message severity code", ["{file}:{line}:{col}: {message} [Error/{code}]"], alts=((r"^" + LOC + r": (error|warning) ([\w-]+\([\w/-]+\)): (.+)$", "file line col severity code message"), (r"^\s*[×x] (?:([\w-]+\([\w/-]+\)): )?(.+)$", "code message")),
       at=r"[╭,][─-]\[([^\s:\]]+):(\d+):(\d+)\]", reach=3, commands=("oxlint",)),
    _r("black", "lint", ["would reformat", "cannot format"], r"^(?:would reformat|error: cannot format) ([^\s:]+)(?::.*)?$", "file", ["would reformat {file}"], constants={"label": "format", "message": "would reformat"}, commands=("black",)),
    _r("prettier", "lint", ["[warn]", "[error]"], r"^\[(?:warn|error)\] (\S+\.\w+)(?:: (.+?) \((\d+):(\d+)\))?$", "file message line col", ["[error] {file}.js: {message} ({line}:{col})"], constants={"label": "format"}, commands=("prettier",)),
    _r("sass", "compile", ["root stylesheet"], r"^Error: (.+)$", "message", ["Error: {message}", "  {file} {line}:{col}  root stylesheet"], at=r"^\s+(\S+) (\d+):(\d+)\s+root stylesheet", reach=40, constants={"label": "sass"}, commands=("sass",)),
    _r("less", "compile", [" on line "], r"^(\w+Error): (.+) in (\S+) on line (\d+), column (\d+):?$", "code message file line col", ["{code}Error: {message} in {file} on line {line}, column {col}:"], commands=("lessc",)),
    _r("webpack", "compile", ["ERROR in "], r"^ERROR in (\S+) (\d+):(\d+)(?:-\d+)?$", "file line col", ["ERROR in {file} {line}:{col}"], constants={"label": "webpack", "message": "module error"}, commands=("webpack",)),
    _r("babel", "compile", ["Error: "], r"^(\w*Error): ([^\s:]+): (.+) \((\d+):(\d+)\)$", "code file message line col", ["SyntaxError: {file}: {message} ({line}:{col})"], commands=("babel",)),
    _r("swc", "compile", ["╭─["], r"^\s*[×x] (.+)$", "message", ["  × {message}", "   ╭─[{file}:{line}:{col}]"], at=r"╭─\[([^\s:\]]+):(\d+):(\d+)\]", reach=3, constants={"label": "swc"}, commands=("swc",)),
    _r("pyright", "typecheck", [" - error: "], r"^\s+([^\s:]+):(\d+):(\d+) - (error|warning): (.+?)(?: \((\w+)\))?$", "file line col severity message code", ["  {file}:{line}:{col} - error: {message} (report{code})"], commands=("pyright",)),
    _r("mypy", "typecheck", [": error: "], r"^([^\s:]+\.pyi?):(\d+):(?:(\d+):)? (error|note): (.+?)(?:  \[([\w-]+)\])?$", "file line col severity message code", ["{file}.py:{line}:{col}: error: {message}  [{code}]"], commands=("mypy",)),
    _r("cmake", "build", ["CMake Error"], r"^CMake Error at ([^\s:]+):(\d+) \((\w+)\):$", "file line code", ["CMake Error at {file}:{line} ({code}):"], constants={"message": "configure error"}, alts=((r"^CMake Error(?: in [^:]+)?: (.+)$", "message"),), commands=("cmake",)),
    _r("terraform", "build", [".tf line ", "erraform", "│ Error: ", "tofu"], r"^[│╷ ]*Error: (.+)$", "message", ["│ Error: {message}", "│   on {file}.tf line {line}, in resource:"], at=r"on (\S+\.tf) line (\d+)", at_groups=("file", "line"), reach=6, constants={"label": "terraform"}, commands=("terraform", "tofu")),
    _r("terraform fmt", "lint", ["--- old/", "+++ new/"], r"^--- old/(\S+\.(?:tf|tfvars|hcl))$", "file", ["--- old/{file}.tf", "+++ new/{file}.tf"], block=Block(hunks=r"^---"), constants={"label": "format", "message": "not formatted"}, commands=("terraform", "tofu")),
    _r("swift test", "test", ["Test Case '", "recorded an issue at"], r"^(\S+\.swift):(\d+): error: (?:-\[)?([\w.]+[. ]\w+)\]? : (.+)$", "file line subject message", ["Test Case '-[Shop {subject}]' started.", "{file}.swift:{line}: error: -[Shop {subject}] : {message}"], alts=((r"^✘ Test (.+?) recorded an issue at ([^\s:]+):(\d+):(\d+): (.+)$", "subject file line col message"),), commands=("swift",)),
    _r("swift", "compile", [".swift:"], r"^(\S+\.swift):(\d+):(\d+): (error|warning): (.+)$", "file line col severity message", ["{file}.swift:{line}:{col}: error: {message}"], constants={"label": "swift"}, commands=("swift", "swiftc")),
    _r("clang", "compile", [": error: ", ": fatal error: "], r"^([^\s:]+\.(?:c|cc|cpp|cxx|h|hpp|m|mm)):(\d+):(\d+): (?:fatal )?(error|warning): (.+?)(?: \[-W([\w-]+)\])?$", "file line col severity message code", ["{file}.c:{line}:{col}: error: {message}"], commands=("clang", "gcc", "cc", "g++")),
    _r("minitest", "test", ["# Running:", "assertions/s", "Failure: "], r"^(?:Failure|Error):?\s+(\w+#\w+) \[([^\s:]+):(\d+)\]:?$", "subject file line", ["Failure: Case#{subject} [{file}:{line}]:"],
       alts=((r"^([A-Z][\w:]*#test_\w+)(?: \[([^\s:]+):(\d+)\])?:$", "subject file line"),), at=r"^\s+([^\s:]+\.rb):(\d+):in ", at_groups=("file", "line"), reach=6, constants={"message": "test failed"}, commands=("rake",)),
    _r("ruby", "runtime", [".rb:"], r"^([^\s:]+\.rb):(\d+):in [`']([^']+)': (.+) \((\w+(?:::\w+)*)\)$", "file line label message code", ["{file}.rb:{line}:in 'f': {message} ({code}Error)"], commands=("ruby",)),
    _r("perl", "runtime", [" at ", " line "], r"^(.+) at (\S+\.p[lm]) line (\d+)\.$", "message file line", ["{message} at {file}.pl line {line}."], constants={"label": "perl"}, commands=("perl",)),
    _r("php", "runtime", ["PHP ", "Fatal error"], r"^PHP (?:Fatal|Parse) error:\s+(?:Uncaught (\w+): )?(.+) in (\S+?)(?: on line |:)(\d+)$", "code message file line", ["PHP Fatal error:  Uncaught {code}: {message} in {file}.php:{line}"], commands=("php",)),
    _r("rspec", "test", ["rspec "], r"^rspec ([^\s:]+):(\d+) # (.+)$", "file line subject", ["rspec {file}:{line} # {subject}"], constants={"message": "example failed"}, commands=("rspec",)),
    _r("jvm test", "test", [" FAILED", "[ERROR]   ", "[ERROR] Failures:", "Tests run: "], r"^([\w$.]+ > .+?) FAILED$", "subject", ["CartTest > {subject} FAILED", "    at CartTest.java:{line}"], alts=((r"^\[ERROR\]\s+([\w$.]+[.:][\w$]+):(\d+) (.+)$", "subject line message"), (r"^\[ERROR\] ([\w$.]+\.[\w$]+)(?:\(.*\))? (?:--|<<<) .*(?:FAILURE|ERROR)!$", "subject")),
       at=r"\bat (?:.*\()?([\w$]+\.(?:java|kt|groovy)):(\d+)\)?", at_groups=("file", "line"), reach=8, constants={"message": "test failed"}, commands=("mvn", "gradle")),
    _r("jvm", "compile", ["[ERROR] ", ".java:"], r"^(?:\[ERROR\] )?(\S+\.(?:java|kt)):(?:\[(\d+),(\d+)\]|(\d+):(?: error:)?) (.+)$", "file line col line message", ["[ERROR] {file}.java:[{line},{col}] {message}"], constants={"label": "javac"}, commands=("mvn", "gradle", "javac")),
    _r("dotnet test", "test", ["[xUnit.net ", ".dll (net", ".NETCoreApp,Version", "  Failed ", "NUnit"], r"^\[xUnit\.net [\d:.]+\]\s+(.+) \[FAIL\]$", "subject", ["[xUnit.net 00:00:00.06]     Shop.{subject} [FAIL]", "   at Shop.Run() in /src/{file}.cs:line {line}"],
       alts=((r"^  [^\s\[].*?\s([\w.+]+(?:\(.*\))?) \[(?:< )?[\d.,]+ ?\S+\]$", "subject"), (r"^(?!passed|skipped)[^\W\d_]+ ([A-Za-z_][\w.+]*(?:\(.*\))?) \((?:\d+[hms] )*[\d.]+ ?m?s\)$", "subject")),
       at=r"[ :]((?:[A-Za-z]:|/)[^:]*\.(?:cs|fs|vb)):(?:\S+ )?(\d+)$", at_groups=("file", "line"), reach=12, constants={"message": "test failed"}, commands=("dotnet",)),
    _r("dotnet", "compile", ["): error "], r"^\s*([^\s(]+\.(?:cs|fs|vb))\((\d+),(\d+)\): error (\w+): (.+?)(?: \[.+\])?$", "file line col code message", ["{file}.cs({line},{col}): error CS{line}: {message}"], commands=("dotnet",)),
    _r("phpunit", "test", ["PHPUnit"], r"^\d+\) ([\w\\]+::\w+)$", "subject", ["PHPUnit 11", "1) Case::{subject}", "{file}:{line}"], at=r"^((?:/.+|[^\s:]+?)(?:\.php)?):(\d+)$", at_groups=("file", "line"), reach=20, constants={"message": "test failed"}, commands=("phpunit",)),
    _r("cargo fmt", "lint", ["Diff in "], r"^Diff in ([^\s:]+):(\d+):$", "file line", ["Diff in {file}:{line}:"], constants={"label": "format", "message": "not formatted"}, commands=("cargo",)),
    _r("cargo", "compile", ["error[E", " --> ", "panicked at ", "could not compile", "Compiling "], r"^error(?:\[(E\d{4})\])?: (.+)$", "code message", ["error[E00{line}0]: {message}", "  --> {file}:{line}:{col}"], at=r"^\s+--> ([^\s:]+):(\d+):(\d+)$", reach=4, alts=((r"^thread '(.+?)'(?: \(\d+\))? panicked at ([^\s:]+):(\d+):(\d+):$", "subject file line col"), (r"^thread '(.+?)' panicked at '(.+)', ([^\s:]+):(\d+):(\d+)$", "subject message file line col")), commands=("cargo", "rustc")),
    _r("gofmt", "lint", ["diff ", ".orig"], r"^diff (\S+)\.orig \S+$", "file", ["diff {file}.orig {file}"], block=Block(hunks=r"^---(?! \S+\.orig\s*$)"), constants={"label": "format", "message": "not formatted"}, commands=("gofmt",)),
    _r("go mod", "build", ["go.mod:"], r"^(?:go: errors parsing )?(go\.mod):(\d+): (.+)$", "file line message", ["go.mod:{line}: {message}"], constants={"label": "go.mod"}, commands=("go",)),
    _r("go test json", "test", ['"Action":"'], r'"Action":"fail",.*"Test":"([^"]+)"', "subject", ['{"Action":"output","Package":"p","Test":"{subject}","Output":"    {file}_test.go:{line}: {message}\\n"}', '{"Action":"fail","Package":"p","Test":"{subject}"}'],
       at=r'"Output":"\s+([^\s:]+_test\.go):(\d+): ([^"]*)\\n"', at_groups=("file", "line", "message"), block=Block(events=True, needs=True), constants={"tool": "go test"}, commands=("go",)),
    _r("go test", "test", ["--- FAIL: "], r"^\s*--- FAIL: (\S+)(?: \(.+\))?$", "subject", ["--- FAIL: {subject} (0.00s)", "    {file}_test.go:{line}: {message}"], at=r"^\s+([\w./\\-]+\.go):(\d+)(?:: ?(.*)| \+0x[0-9a-f]+)$", at_groups=("file", "line", "message"),
       block=Block(closes=r"^(?:(?:FAIL|ok)\s+\S+\s+(?:[\d.]+s|\(cached\))|FAIL|PASS)\s*$", keys=r"^\s*(?:=== (?:RUN|PAUSE|CONT|NAME)\s+|--- (?:PASS|SKIP): )(\S+)", says=r"^(panic: .+?)(?:\s\[recovered.*\])?$", needs=True), constants={"message": "test failed"}, commands=("go",)),
    _r("go", "compile", [".go:"], r"^(?:vet: )?(?:\./)?([^\s:]+\.go):(\d+):(\d+): (.+)$", "file line col message", ["./{file}.go:{line}:{col}: {message}"], constants={"label": "go"}, commands=("go",)),
    _r("esbuild", "compile", ["✘ [ERROR]"], r"^✘ \[ERROR\] (.+)$", "message", ["✘ [ERROR] {message}", "    {file}:{line}:{col}:"], at=r"^\s+([^\s:]+):(\d+):(\d+):$", reach=4, constants={"label": "esbuild"}, commands=("esbuild",)),
    _r("vite", "compile", ["error during build:"], r"^\[([A-Z_]+)\] (.+)$", "code message", ["error during build:", "[PARSE_ERROR] {message}", " ╭─[ {file}:{line}:{col} ]"], at=r"╭─\[ ([^\s:]+):(\d+):(\d+) \]", reach=4, commands=("vite",)),
    _r("node", "runtime", ["    at "], r"^(?:Uncaught )?(\w*Error)(?: \[\w+\])?: (.+)$", "code message", ["TypeError: {message}", "    at f ({file}:{line}:{col})"], at=r"^\s+at (?:.* \()?([^()\s:]+):(\d+):(\d+)\)?$", reach=4, commands=("node",)),
    _r("tsc", "typecheck", ["error TS"], r"^(\S+?)[:(](\d+)[:,](\d+)\)?(?: -|:) error (TS\d+): (.+)$", "file line col code message", ["{file}.ts({line},{col}): error TS{line}: {message}"], commands=("tsc",)),
    _r("git", "vcs", ["fatal: ", "CONFLICT (", "error: failed to push", "error: pathspec", "error: Your local changes", "error: could not apply", "! [rejected]", "error: patch failed"], r"^(?:fatal|error|CONFLICT \([\w/ ]+\)): (.+)$", "message", ["fatal: {message}"], constants={"label": "git"}, commands=("git",)),
    _r("kubectl", "deploy", ["Error from server", "error: the server", "error: unable to", "error: error validating", "error: error parsing", "kubectl"], r"^(?:Error from server \((\w+)\)|error): (.+)$", "label message", ["Error from server (NotFound): {message}"], commands=("kubectl",)),
    _r("docker", "build", ["Dockerfile:", "ERROR: failed to"], r"^ERROR: (failed to .+)$", "message", ["Dockerfile:{line}", "ERROR: failed to solve: {message}"], at=r"^(Dockerfile[\w.]*):(\d+)$", at_groups=("file", "line"), reach=-12, constants={"label": "docker"}, commands=("docker",)),
    _r("make", "build", ["***"], r"^g?make(?:\[\d+\])?: \*\*\* (?:\[([^\s:\]]+):(\d+): )?(.+?)\]?(?:\.  Stop\.| Error \d+)$", "file line message", ["make: *** [{file}:{line}: {message}] Error 1"], constants={"label": "make"}, commands=("make", "gmake")),
    _r("npm", "package", ["npm error", "npm ERR!"], r"^npm (?:error|ERR!) code (\S+)$", "code", ["npm error code E{code}"], constants={"message": "npm failed"}, commands=()),
    _r("pnpm", "package", ["ERR_PNPM"], r"^\s*(?:ERROR\s+)?(ERR_PNPM_\w+)\s+(.+)$", "code message", [" ERR_PNPM_{code}  {message}"]),
    _r("yarn", "package", ["yarn "], r"^error (.+)$", "message", ["yarn install v1.22.0", "error {message}"], constants={"label": "yarn"}, commands=("yarn",)),
    _r("pip", "package", ["ERROR: "], r"^ERROR: (?:Could not find a version that satisfies the requirement (\S+).*|(.+))$", "subject message", ["ERROR: {message}"], constants={"label": "pip"}, commands=("pip",)),
    _r("bundler", "package", ["Could not find "], r"^Could not find (?:gem '([^']+)'|(\S+)) in (.+)$", "subject subject message", ["Could not find gem '{subject}' in {message}"], commands=("bundle",)),
    _r("composer", "package", ["Problem "], r"^\s+- (Root composer\.json .+|.+ requires .+)$", "message", ["  Problem 1", "    - Root composer.json requires {message}"], constants={"label": "composer"}, commands=("composer",)),
    _r("uv", "package", ["No solution found", "uv 0.", "uv.lock", "uv pip", "uv sync", "`uv ", "hint: ", "Because only ", "in the package registry"], r"^\s*(?:error:|×) (.+)$", "message", ["uv 0.5.1", "  × {message}"], constants={"label": "uv"}, commands=("uv",)),
    _r("poetry", "package", ["version solving failed"], r"^(Because .+), version solving failed\.$", "message", ["Because {message}, version solving failed."], constants={"label": "poetry"}, commands=("poetry",)),
    _r("generic", "unknown", ["rror", "ailed", "FAIL", "anic", "xception"], r"(?i)^((?:.*\b)?(?:error|fatal|failed|panic|exception)\b.*)$", "message", ["unexpected failure: error {message}"], constants={"guessed": True}),
)
NAMES = tuple(r.name for r in READERS)
