"""Every server-source rule of the survey's appendix C.3 has a line that it finds, and the whole-file rule looks at all lines."""

from rampart.operators.actions import AHEAD_RULES, FILE_RULES, SERVER_RULES, server_findings


def test_added_rules(spark):
    lines = ["execSync(`ls ${dir}`)", "fs.writeFileSync(name, x)", "axios.get(address)", "fetch('https://a.example/x')", "fetch('http://localhost:80/')", "new WebSocket(u)", "exec('ls ' + x)", "app.use(cors())", "http.createServer(f)"]
    rows = [("a.js", "javascript", i, t) for i, t in enumerate(lines)] + [("b.js", "javascript", 0, "app.listen(80)"), ("b.js", "javascript", 1, "check(session)")]
    got = {(r.path, r.line, r.rule.removeprefix("mcp.")) for r in server_findings(spark.createDataFrame(rows, "path string, language string, line int, text string")).collect()}
    want = {(1, "shell-exec-no-validation"), (2, "fs-write-no-path-validation"), (3, "http-request-user-url"), (4, "exfiltration-external-request"), (6, "exfiltration-network-socket"), (7, "exec-string-concat"), (7, "shell-exec-no-validation"), (8, "cors-permissive"), (9, "no-auth-check")}
    added = {r for _, r in want}
    assert {x for x in got if x[2] in added} == {("a.js", *x) for x in want}
    assert len({r[0] for r in SERVER_RULES + AHEAD_RULES + FILE_RULES}) == 24


def test_rules_with_frames(spark):
    """What must not stand in the lines around, near and just beyond the frame."""
    told = {
        "a.js": ["new URL(address)", "x", "x", "x", "x", "if (u.hostname === 'a') {}"],
        "b.js": ["new URL(address)", "x", "if (u.hostname === 'a') {}"],
        "c.js": ["path.resolve(p)", "x", "x", "x", "x", "readFile(p)"],
        "d.js": ["path.resolve(p)", "x", "x", "x", "x", "x", "readFile(p)"],
        "e.js": ["server.tool('a', 'b', {}, async ({ x }) => {", "z.string()"],
        "f.js": ["server.tool('a', 'b', {}, async ({ x }) => {"],
        "g.py": ["k = os.getenv('A')", "requests.post('https://a.example/')", "requests.post('http://localhost/')"],
    }
    rows = [(p, "python" if p.endswith("py") else "javascript", i, t) for p, lines in told.items() for i, t in enumerate(lines)]
    got = {(r.path, r.line, r.rule.removeprefix("mcp.")) for r in server_findings(spark.createDataFrame(rows, "path string, language string, line int, text string")).collect()}
    assert got == {("a.js", 1, "url-no-validation"), ("d.js", 7, "path-no-normalize"), ("f.js", 1, "no-input-validation"), ("g.py", 1, "env-var-exposure-python"), ("g.py", 2, "exfiltration-external-request-python")}
