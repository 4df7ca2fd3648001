"""Attack signatures as one table, and the detectors that are disjunctions of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.decode import normalize_payload, unescape_html

def _words(*names: str) -> str:
    return f"(?:{'|'.join(names)})"


#: Stands between the parts of a request; and the end of a part, or of the text.
PART = "\x1f"
END = r"(?:$| ?\x1f)"

# Vocabularies. Each names the public document that its words come from; patterns are composed of them.
#: Statements of SQL (ISO/IEC 9075-2, clauses 11 to 16) that read or change data or schemas.
SQL_VERBS = _words("alter", "call", "commit", "create", "declare", "delete", "drop", "execute", "grant", "insert", "merge", "revoke", "rollback", "select", "truncate", "update")
#: What schema statements act upon (the same, clause 11).
SQL_OBJECTS = _words("column", "constraint", "database", "function", "index", "procedure", "role", "schema", "sequence", "table", "trigger", "user", "view")
#: General value specifications that take no brackets (the same, clause 6.4).
SQL_VALUES = _words("current_catalog", "current_role", "current_schema", "current_user", "session_user", "system_user")
#: Catalogues in the manuals of PostgreSQL, SQLite, MySQL, SQL Server and Oracle.
SQL_CATALOGUES = _words("information_schema", "pg_catalog", r"pg_(?:shadow|user|tables)", r"sqlite_(?:master|schema)", r"mysql\.\w+", "sysobjects", r"sys\.\w+", r"(?:all|dba|user)_(?:tables|users|tab_columns)")
#: Functions in the same manuals that wait, read files, call out, or show data in errors.
SQL_FUNCTIONS = _words(r"dbms_\w+", "extractvalue", "group_concat", "listagg", "lo_import", "load_file", "randomblob", "string_agg", "updatexml", r"utl_\w+", "xmltype")
#: Identifier of SQL, quoted or not.
_NAME = r"[\w.`\"\[\]]+"

#: Utilities of POSIX (IEEE 1003.1, volume XCU) and of Windows (its commands reference) that tell about a machine, fetch or run
#: something. The second kind are words of English too and count with an option or a path only.
PROGRAMS = _words(
    "awk", "base64", "bash", "certutil", "chmod", "chown", "curl", "dash", "dig", "hostname", "ifconfig", "ipconfig", "ksh", "ls", "mkfifo", "nc", "ncat", "netcat", "netstat", "nslookup", "perl",
    "php", "powershell", r"python[\d.]*", "rm", "ruby", "sed", "sh", "systeminfo", "tasklist", "telnet", "uname", "wget", "whoami", "xargs", "zsh",
)
ENGLISH_PROGRAMS = _words("cat", "cmd", "cp", "dir", "echo", "env", "find", "grep", "head", "host", "id", "kill", "less", "more", "mv", "net", "node", "ping", "ps", "sleep", "tail", "tar", "touch", "type", "who")
#: Control operators of the shell's grammar (XCU, chapter 2), and what begins a command substitution.
_CONTROL = r"(?:[;|&`]|\$\()[\s{(]*(?:[\w.]*/[\w./]*/)?"
#: A new line as well, where an option or a path follows the program.
_LINE = r"(?:[;|&`\r\n]|\$\()[\s{(]*(?:[\w.]*/[\w./]*/)?"
_ENDS = r"(?=$|[\x1f\s;|&)`<>/\\'\",])"
#: Messages of errno (XSH, chapter 2.3) as utilities print them after their name and operand.
ERRNO = _words("cannot execute", "connection refused", "exec format error", "is a directory", "no such file or directory", "not a directory", "operation not permitted", "permission denied", "read-only file system")

#: Elements of HTML that run, load, style or send something (the WHATWG standard, chapters 4.2, 4.8, 4.10, 4.12, and its obsolete ones).
ELEMENTS = _words("applet", "audio", "base", "body", "button", "details", "embed", "form", "frame", "iframe", "image", "img", "input", "isindex", "link", "marquee", "math", "meta", "object", "script", "select", "style", "svg", "template", "textarea", "video")
#: Schemes of browsers, past and present, that run what follows.
SCRIPT_SCHEMES = _words("javascript", "livescript", "mocha", "vbscript")

#: Schemes that libcurl lists as its protocols, besides those of the web, and two of Java's.
FETCH_SCHEMES = _words("dict", "file", "gophers?", "imaps?", "jar", "ldaps?", "mqtts?", "netdoc", "pop3s?", "rtmp[est]*", "rtsp", "scp", "sftp", "smbs?", "smtps?", "telnet", "tftp", "wss?")
#: A part of an address as inet_aton() reads it, and those that say 127.
_PART, _LOOP = r"(?:0x[0-9a-f]{1,8}|\d{1,10})", r"(?:127|0+177|0x0*7f)"
#: Where a host stands.
_HOST = r"(?:^|[=/@])"

#: Product tokens of scanners and guessers, as the tools' own documentation gives their agents.
SCANNERS = _words(
    "acunetix", "arachni", "burp", "commix", "dirbuster", "dirsearch", "droopescan", "feroxbuster", r"fuzz faster u fool|ffuf", "gobuster", "hydra", "jaeles", "joomscan", "masscan", "medusa", "metasploit", "nessus", "netsparker",
    "nikto", r"nmap(?: scripting engine)?", "nuclei", "openvas", "patator", "projectdiscovery", "qualys", "skipfish", "sqlmap", "w3af", "wapiti", "wfuzz", "whatweb", "wpscan", "zaproxy", "zgrab",
)
#: Clients of scripts by their default agents; they name no browser or app.
LIBRARIES = _words("aiohttp", "apache-httpclient", "curl", "go-http-client", "guzzlehttp", "java", "libwww-perl", "lwp::simple", "php", "postmanruntime", "python-httpx", "python-requests", "python-urllib", "ruby", "scrapy", "wget")

#: class, tier, pattern (Java); texts are lower case. Each tier is a kind of sign.
SIGNATURES: tuple[tuple[str, str, str], ...] = (
    ("sqli", "catalogue", rf"\b{SQL_CATALOGUES}\b|\b{SQL_VALUES}\b|@@[a-z_]{{3,40}}\b"),
    ("sqli", "function", rf"\b{SQL_FUNCTIONS}\s?[(.]|\b(?:version|database|schema|user|current_database)\(\s?\)|\b(?:pg_)?sleep\(\s?\d|\bbenchmark\(\s?\d|\bwaitfor (?:delay|time) ['\"\d]"),
    ("sqli", "function", r"\b(?:substr|substring|mid|concat|concat_ws|ifnull|nullif)\([^()]{1,80},|\b(?:ascii|ord|chr|char|unhex)\(\s?(?:\d|0x|\w+\()"),
    ("sqli", "function", r"\bxp_\w{3,30}|\binto (?:out|dump)file\b|\bexec(?:ute)? (?:immediate\b|master\b|[sx]p_|@)"),
    # statements: whole ones by their grammar, or one after a semicolon
    ("sqli", "statement", rf"\bunion (?:(?:all|distinct) )?\(?\s?select\b|;\s?{SQL_VERBS} [\w@*(`]|;\s?shutdown\b"),
    ("sqli", "statement", rf"\bselect [\w.*,()@'\" ]{{1,200}}? from {_NAME} ?(?:where\b|limit\b|order by\b|group by\b|having\b|join\b|union\b|;|--|#|/\*|\))"),
    ("sqli", "statement", rf"\binsert into {_NAME} ?(?:\(|values\b|select\b)|\bdelete from {_NAME} ?(?:{END}|where\b|;|--|&)|\bupdate {_NAME} set {_NAME} ?(?:=|{END})"),
    ("sqli", "statement", rf"\b(?:create|alter|drop|truncate) {SQL_OBJECTS} (?:if (?:not )?exists )?{_NAME} ?(?:\(|;|--|add\b|drop column\b|as select\b|identified by\b)"),
    ("sqli", "clause", rf"\b(?:order|group) by \d|\bgroup by {_NAME} having\b|\bhaving \d+ ?[=<>]|\bcase when [^?]{{1,100}}?[=<>(].{{1,100}}?\bthen\b|\blimit \d+ ?(?:,|offset) ?\d"),
    # conditions that always hold, or that go on after the end of a value
    ("sqli", "tautology", r"(?:^|[\s('\"=&|])(?<number>\d{1,20}) ?= ?\k<number>(?![\w.])"),
    ("sqli", "tautology", rf"(?<quote>['\"])(?<word>\w{{0,40}})\k<quote> ?= ?\k<quote>\k<word>(?:\k<quote>|{END})"),
    ("sqli", "tautology", r"['\")\d] ?(?:or|and|xor|\|\||&&) ?(?:not )?['\"(]?\w{1,40}['\")]? ?(?:=|<|>|!=|like ['\"])"),
    ("sqli", "tautology", r"['\")\d] ?or (?:true|not false|not \d)\b|^[^(]{0,500}\) ?(?:or|and) ?\(|\blike ['\"]\w{0,40}%"),
    ("sqli", "cut", rf"['\"] ?(?:--(?:[ +]|{END})|#{END}|/\*)|\d --{END}"),
    # white space is gone from these texts
    ("xss", "tag", rf"</?{ELEMENTS}(?:[/>=]|[a-z-]{{2,20}}=|{END})"),
    ("xss", "handler", r"<[^>]{1,300}\bon[a-z]{3,20}=|[/\"'a-z0-9]on(?:load|error|click|focus|blur|mouse\w{1,12}|toggle|begin|start|key\w{1,8}|submit|animation\w{1,12})=|[/\"'`]on[a-z]{3,20}="),
    ("xss", "scheme", rf"{SCRIPT_SCHEMES}:|data:text/html"),
    ("xss", "code", r"\b(?:alert|prompt|confirm|eval|settimeout|setinterval|atob)[(`]|(?:^|[^a-z0-9_])(?:new)?function\(['\"`]|document\.(?:cookie|write|location|domain)|string\.fromcharcode|window\.location|\.innerhtml"),
    ("xss", "style", r"expression\(|-moz-binding|@import['\"(u]"),
    ("xss", "outbreak", r"['\"]/?>+<[a-z!/]|['\"](?:autofocus|style|src|href|formaction|xlink:href)="),
    ("rce", "chain", rf"{_CONTROL}{PROGRAMS}{_ENDS}(?!\s*=)|{_LINE}(?:{PROGRAMS}|{ENGLISH_PROGRAMS})[^\S\r\n]+[-/~.$*][\w/.*{{-]|{_CONTROL}(?:id|ps|env|dir){_ENDS}\s*(?:{END}|[;|&)`])"),
    ("rce", "chain", r"(?:(?<!&)&&|(?<!\|)\|\|)\s*\w"),
    ("rce", "redirect", rf"\d>&\d|(?:[\w)\"'] |^ ?|= ?)>{{1,2}} ?[\w~-]*[./][\w/.-]{{1,100}}(?:{END}|[\s;|&])"),
    ("rce", "path", r"/(?:usr/(?:local/)?)?s?bin/\w|/etc/(?:passwd|shadow|group|crontab|sudoers)\b|/dev/(?:tcp|udp)/|\bcmd\.exe\b|\bsystem32\\\w"),
    # a command by itself, as a web shell takes it
    ("rce", "command", rf"(?:^|[=?])\s*(?:whoami|ifconfig|ipconfig|systeminfo|tasklist)\s*(?:{END}|&|\s[a-z]+/)|\b(?:uname|netstat|powershell) -\w|\bip (?:addr|route|link|neigh)\b|\b(?:cat|head|less|more|tail|type) (?:/|~/|\.\./|[a-z]:\\)\w"),
    ("rce", "reverse", r"\b(?:ba|c|da|k|z)?sh -[a-z]{0,5}[ic]\b|\b(?:nc|ncat|netcat) (?:-\w+ ){0,5}-\w{0,5}e\b|\bmkfifo /|\bbase64 (?:-d|--decode)\b|\b(?:python[\d.]*|perl|php|ruby) -[ecr]\b"),
    ("rce", "code", r"\b(?:exec|shell_exec|passthru|popen|proc_open|pcntl_exec)\([^)\s]|\bsystem\((?!s\))[^)\s]|\b(?:eval|assert)\((?:base64_decode|\$_|gzinflate|str_rot13)"),
    # what shells and utilities print, by their formats: shell: [line] n: ..., utility: operand: message, and some programs' own
    ("rce_output", "shell", r"(?:^|\s)(?:[\w/]*/)?(?:ba|c|da|k|z)?sh: (?:line )?\d+: |\bcommand not found\b"),
    ("rce_output", "tool", rf"(?:^|\s)[a-z][\w.+-]{{0,20}}: [^:]{{1,200}}: {ERRNO}\b"),
    ("rce_output", "tool", r"\buid=\d+\([^)]{0,60}\) gid=\d+|\bresolving [\w.-]+\.{3} |\bconnecting to [\w.-]+\|[\d.a-f:]+\|:\d+\.{3}|\bterm environment variable not set\b|\bno lsb modules are available\b"),
    ("lfi", "path", r"(\.\.[/\\]){1,}"), ("lfi", "path", r"(/|\\)(etc/(passwd|shadow|hosts|group|issue)|proc/(self|version|cpuinfo)|windows[/\\](win\.ini|system32)|boot\.ini|var/log/)"), ("lfi", "wrapper", r"\b(php|zip|phar|expect|glob|data|file)://"), ("lfi", "path", r"\.\.(%2f|%5c|;/)"),
    # where clouds tell a machine about itself, by the addresses, names, paths and headers in their manuals
    ("ssrf", "metadata", r"\b169\.254\.(?:169\.25[34]|170\.2)\b|\bfd00:ec2::254\b|\b100\.100\.100\.200\b|\bmetadata\.(?:google|azure)\.\w+"),
    ("ssrf", "metadata", r"\blatest/(?:meta-data|user-data|dynamic|api/token)\b|\bcomputemetadata/v1\b|\bopc/v[12]/|\bmetadata-flavor\b|\bx-aws-ec2-metadata\b|\bmetadata: ?true\b"),
    ("ssrf", "scheme", rf"\b{FETCH_SCHEMES}://"),
    # a machine's own address: by name, in one to four parts (127 in any base), as one number, or in IPv6
    ("ssrf", "loopback", rf"{_HOST}(?:localhost\b|{_LOOP}(?:\.{_PART}){{1,3}}(?![\w.])|0\.0\.0\.0\b|0x7f[0-9a-f]{{6}}\b|0+177\d{{8}}\b|21[34]\d{{7}}\b|\[?(?:0*:){{1,7}}:?0*1\](?:[/:]|{END})|::1\b)"),
    ("protocol", "split", r"[\r\n]\s*(set-cookie|location|content-type|content-length|host)\s*:"), ("protocol", "redirect", r"[?&](url|next|redirect|return|dest|goto|continue)=(https?:)?//"), ("protocol", "template", r"\{\{.{1,100}?\}\}|\$\{.{1,100}?\}|<%=.{1,100}?%>"),
    ("scanner", "tool", rf"\b{SCANNERS}\b"),
    ("scanner", "library", rf"^{LIBRARIES}(?:$|/)"),
    # what comes in an agent and is none: look-ups, shell functions, and names that exploit campaigns are known by
    ("scanner", "payload", r"\$\{[^}]{0,40}(?:jndi|lower|env):|\(\)\s*\{|\b(?:zmeu|morfeus)\b|^hello[-, ]{1,2}world"),
)
#: Agents of search engines and link previews, as these document them.
SEARCH_BOTS = r"\b(applebot|baiduspider|bingbot|duckduckbot|facebookexternalhit|googlebot|linkedinbot|slurp|twitterbot|yandexbot)\b"
#: Error messages that are notices and no output of a command.
NOTICE_CODES = ("ah00094", "ah00558")


#: Of each row of a class in turn, what a text that it matches has one of: only such texts are searched, since a search for
#: a fixed text costs a small part of one for a pattern.
GATES: dict[str, tuple[tuple[str, ...], ...]] = {
    "sqli": (
        ("_", "@@", "mysql.", "sysobjects", "sys."),
        ("_", "extractvalue", "listagg", "randomblob", "updatexml", "xmltype", "version(", "database(", "schema(", "user(", "sleep(", "benchmark(", "waitfor "),
        ("substr(", "substring(", "mid(", "concat(", "concat_ws(", "ifnull(", "nullif(", "ascii(", "ord(", "chr(", "char(", "unhex("),
        ("xp_", "into outfile", "into dumpfile", "exec ", "execute "),
        ("union ", ";"), ("select ",), ("insert into ", "delete from ", "update "), ("create ", "alter ", "drop ", "truncate "),
        ("order by ", "group by ", "having ", "case when ", "limit "),
        ("=",), ("=",), ("=", "<", ">", "like '", 'like "'), ("or true", "or not ", ") or", ") and", ")or", ")and", "like '", 'like "'),
        ("--", "#", "/*"),
    ),
    "xss": (
        ("<",), ("=",), ("script:", "mocha:", "data:text/html"),
        ("alert(", "alert`", "prompt(", "prompt`", "confirm(", "confirm`", "eval(", "eval`", "timeout(", "timeout`", "interval(", "interval`", "atob(", "atob`", "function(", "document.", "fromcharcode", "window.location", ".innerhtml"),
        ("expression(", "-moz-binding", "@import"), ("><", "="),
    ),
    "rce": (
        (";", "|", "&", "`", "$(", *(space + sign for space in " \t\x0b\f" for sign in "-/~.$*")), ("&&", "||"), (">",), ("bin/", "/etc/", "/dev/", "cmd.exe", "system32"),
        ("whoami", "ifconfig", "ipconfig", "systeminfo", "tasklist", "uname -", "netstat -", "powershell -", "ip addr", "ip route", "ip link", "ip neigh", " /", " ~/", " ../", ":\\"),
        ("sh -", "nc -", "cat -", "mkfifo /", "base64 -", " -e", " -c", " -r"), ("exec(", "passthru(", "popen(", "proc_open(", "system(", "eval(", "assert("),
    ),
    "lfi": (("../", "..\\"), ("etc/", "proc/", "windows", "boot.ini", "var/log/"), ("://",), ("..%", "..;")),
    "ssrf": (
        ("169.254.", "fd00:ec2::254", "100.100.100.200", "metadata."), ("latest/", "computemetadata/v1", "opc/v", "metadata-flavor", "x-aws-ec2-metadata", "metadata:"), ("://",),
        ("localhost", "127.", "0177", "0x", "0.0.0.0", "213", "214", "1]", "::1"),
    ),
    "protocol": (("set-cookie", "location", "content-", "host"), ("=//", "=http"), ("{{", "${", "<%=")),
}


def signature_table(spark) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "class string, tier string, pattern string")


def _named(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), which may name the value often: it is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests)


def _matches(text: Column, name: str, signatures: tuple[tuple[str, str, str], ...] = SIGNATURES) -> Column:
    """Any row of a class. A table of the caller's own is searched without gates, the patterns of a tier as one alternation."""
    if name in GATES and signatures is SIGNATURES:
        rows = [(F.lit(pattern), needs) for pattern, needs in zip((x[2] for x in signatures if x[0] == name), GATES[name], strict=True)]
        found = _named(text, lambda t: _any(_any(t.contains(x) for x in needs) & F.rlike(t, pattern) for pattern, needs in rows))
        return F.coalesce(found, F.lit(False))
    tiers: dict[str, list[str]] = {}
    for cls, tier, pattern in signatures:
        if cls == name:
            tiers.setdefault(tier, []).append(f"(?:{pattern})")
    return F.coalesce(_any([F.lit(False), *(text.rlike("|".join(patterns)) for patterns in tiers.values())]), F.lit(False))


def _one_space(text: Column) -> Column:
    """Each run of white space as one space."""
    for sign in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return _named(text, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def detect_sqli(payload: Column) -> Column:
    """After comments and runs of white space are one space; what a conditional comment holds is read."""
    open_ = _named(F.lower(payload), lambda t: F.when(t.contains("/*"), F.regexp_replace(F.regexp_replace(t, r"(?s)/\*!\d*(.*?)\*/", " $1 "), r"(?s)/\*.*?\*/", " ")).otherwise(t))
    return _matches(_one_space(open_), "sqli")


def detect_xss(payload: Column) -> Column:
    return _matches(F.lower(unescape_html(payload)), "xss")


def detect_rce(payload: Column) -> Column:
    text = _named(F.lower(payload), lambda t: F.when(t.contains("ifs"), F.regexp_replace(t, r"\$\{?ifs\}?", " ")).otherwise(t))
    return _matches(F.replace(text, F.lit("\0"), F.lit("")), "rce")


def detect_rce_output(message: Column) -> Column:
    text = F.lower(message)
    notice = text.contains(NOTICE_CODES[0]) | text.contains(NOTICE_CODES[1])
    return F.coalesce(~notice, F.lit(False)) & _matches(text, "rce_output")


def detect_lfi(payload: Column) -> Column:
    """After overlong encodings of dot and slashes are repaired; a NUL byte is a hit too."""
    text = F.lower(payload)
    for bad, good in (("%c0%ae", "."), ("%c0%af", "/"), ("%c1%9c", "\\"), ("%e0%80%ae", ".")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.coalesce(payload.contains("\0") | text.contains("%00"), F.lit(False)) | _matches(text, "lfi")


def detect_ssrf(payload: Column) -> Column:
    return _matches(F.lower(payload), "ssrf")


def detect_protocol(payload: Column) -> Column:
    return _matches(F.lower(payload), "protocol")


def detect_scanner_ua(agent: Column) -> Column:
    """An empty or '-' agent is a hit; search bots are not."""
    text = F.lower(F.trim(F.coalesce(agent, F.lit(""))))
    return text.isin("", "-") | (~text.rlike(SEARCH_BOTS) & _matches(text, "scanner"))


DETECTORS = {"SQLi": detect_sqli, "XSS": detect_xss, "RCE": detect_rce, "LFI": detect_lfi, "SSRF": detect_ssrf, "PROTOCOL": detect_protocol}


def tag_events(df: DataFrame, path: str = "uri_path", query: str = "uri_query", agent: str = "user_agent", body: str | None = None, referer: str | None = None, error: str = "error_message", source: str = "event_source", sanitize: bool = True) -> DataFrame:
    """df with layer1_alerts (sorted names of detectors that hit) and layer1_flagged; error logs are read for command output only."""
    have = set(df.columns)
    parts = [F.concat_ws("?", F.col(path), F.nullif(F.col(query), F.lit("")))] + [F.col(c) for c in (body, agent, referer) if c and c in have]
    payload = normalize_payload(*parts, sanitize=sanitize, between=f" {PART} ")
    is_error = F.coalesce(F.col(source).contains("error"), F.lit(False))
    tagged = df.withColumn("_p", payload)
    hits = [F.when(~is_error & test(F.col("_p")), name) for name, test in DETECTORS.items()] + [F.when(~is_error & detect_scanner_ua(F.col(agent)), "SCANNER")]
    if error in have:
        hits.append(F.when(is_error & detect_rce_output(F.col(error)), "RCE_OUTPUT"))
    return tagged.withColumn("layer1_alerts", F.array_sort(F.array_compact(F.array(*hits)))).withColumn("layer1_flagged", F.size("layer1_alerts") > 0).drop("_p")
