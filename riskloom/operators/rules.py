"""The rule catalogue as data, and its DataFrame form."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Rule(NamedTuple):
    rule_id: str
    title: str
    family: str
    pattern: str | None
    cased: bool
    category: str
    severity: str
    score: float
    confidence: float
    cwe: str
    language: str | None
    description: str
    remediation: str


def _secret(rule_id: str, title: str, pattern: str, score: float, conf: float, cwe: str, what: str, cased: bool = False) -> Rule:
    return Rule(rule_id, title, "secret", pattern, cased, "secrets", "CRITICAL", score, conf, cwe, None, f"{what} in plain text.", "Revoke it and read it at run time from a secret store.")


def _malware(rule_id: str, title: str, pattern: str, score: float, cwe: str, category: str, what: str) -> Rule:
    return Rule(rule_id, title, "malware", pattern, False, category, "CRITICAL", score, 0.99, cwe, None, f"{what}.", "Treat the file as hostile: find where it came from and remove it.")


def _sink(rule_id: str, title: str, pattern: str, score: float, cwe: str, category: str, language: str, what: str, instead: str, cased: bool = False) -> Rule:
    return Rule(rule_id, title, "language", pattern, cased, category, "HIGH", score, 0.95, cwe, language, f"{what}.", f"{instead}.")


# Identifiers, titles, patterns, scores, confidences, weaknesses and categories, in registry order.
RULES: tuple[Rule, ...] = (
    _secret("SEC-AWS-001", "AWS Credential Leak", r"""(?:aws_access_key_id|aws_secret_access_key|aws_session_token)\s*=\s*["']?([A-Za-z0-9/+=]{20,})""", 10.0, 0.99, "CWE-798", "A cloud access key"),
    _secret("SEC-GH-001", "GitHub Personal Access Token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}", 9.5, 0.99, "CWE-798", "A code-hosting access token"),
    _secret("SEC-KEY-001", "Exposed Private Key", r"-----BEGIN\s+([A-Z\s]+)?PRIVATE\s+KEY-----", 10.0, 0.99, "CWE-321", "A private key", cased=True),
    _secret("SEC-API-001", "Potential Hardcoded API Key/Token", r"""(?:api[_-]?key|secret[_-]?key|auth[_-]?token)\s*=\s*["']([a-zA-Z0-9_\-]{16,})["']""", 8.5, 0.95, "CWE-798", "An API key or token"),
    _secret("SEC-PASS-001", "Hardcoded Plaintext Password", r"""password\s*=\s*["']([^"']{4,})["']""", 8.0, 0.95, "CWE-259", "A password"),
    _malware("MAL-PHP-WEBSHELL-001", "Obfuscated Webshell Payload (PHP Obfuscation)", r"(?:eval|assert|preg_replace)\s*\(\s*(?:base64_decode|gzinflate|gzuncompress|str_rot13)\s*\(", 10.0, "CWE-94", "malware", "Code that decodes a payload and runs it"),
    _malware("MAL-REV-TCP-001", "Reverse Shell Connection (/dev/tcp)", r"(?:/dev/tcp/[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}/\d+|bash\s+-i\s+>&?\s*/dev/tcp)", 10.0, "CWE-78", "reverse_shell", "A shell whose input and output go over a socket"),
    _malware("MAL-NETCAT-001", "Netcat Backdoor / Reverse Shell", r"(?:nc|netcat|ncat)\s+(?:-[a-zA-Z]*e\s+|.*-c\s+)(?:/bin/sh|/bin/bash|cmd\.exe|powershell)", 10.0, "CWE-78", "reverse_shell", "A network tool that hands a shell to its peer"),
    _malware("MAL-PIPED-EXEC-001", "Dangerous Remote Execution via Piped Shell (curl/wget | sh)", r"(?:curl|wget)\s+[^|;\n]+\|\s*(?:ba)?sh\b", 9.8, "CWE-78", "malware", "A download that goes straight to a shell"),
    _malware("MAL-PWSH-ENC-001", "Encoded PowerShell Dropper / Payload", r"powershell(?:\.exe)?\s+.*-(?:enc|encodedcommand|e)\s+[A-Za-z0-9+/=]{8,}", 9.8, "CWE-78", "malware", "An encoded command for a shell"),
    _sink("PY-DYN-001", "Dangerous Dynamic Code Execution (eval/exec)", r"(?<!\.)\b(?:eval|exec)\s*\(", 9.0, "CWE-95", "command_execution", "python", "Text is run as code", "Parse data with a literal parser"),
    _sink("PY-CMD-001", "Command Injection Risk (shell=True)", r"subprocess\.(?:Popen|call|run)\s*\(.*shell\s*=\s*True", 9.5, "CWE-78", "command_execution", "python", "A command line goes through a shell", "Pass a list of arguments, without a shell"),
    _sink("PY-DESERIAL-001", "Insecure Deserialization (pickle.loads)", r"pickle\.loads\s*\(", 9.8, "CWE-502", "deserialization", "python", "Unpickling can run any code", "Use a data-only format"),
    _sink("JS-XSS-001", "Cross-Site Scripting (XSS) via dangerouslySetInnerHTML", r"dangerouslySetInnerHTML", 7.5, "CWE-79", "xss", "javascript", "Markup goes into a page unescaped", "Render text, or sanitise the markup"),
    _sink("GO-SQLI-001", "Go SQL Injection Risk (fmt.Sprintf)", r"(?:db\.Query|db\.Exec|QueryRow)\s*\(\s*fmt\.Sprintf", 9.0, "CWE-89", "injection", "go", "A query is formatted from parts", "Use placeholders"),
    _sink("GO-MEM-001", "Dangerous Go Memory Manipulation (unsafe.Pointer)", r"unsafe\.Pointer\s*\(", 7.0, "CWE-119", "memory_safety", "go", "Type safety is bypassed", "Use typed pointers"),
    _sink("RUST-UNSAFE-001", "Unsafe Rust Code Block (Memory Safety Risk)", r"\bunsafe\s*\{", 7.2, "CWE-119", "memory_safety", "rust", "A block the compiler doesn't check", "Use a safe interface, or prove the block sound", cased=True),
    _sink("JAVA-CMD-001", "Java Command Execution Risk (Runtime.exec/ProcessBuilder)", r"(?:Runtime(?:\.getRuntime\(\))?\.exec|ProcessBuilder)\s*\(", 9.5, "CWE-78", "command_execution", "java", "A process is started", "Check arguments against a list of allowed ones"),
    _sink("JAVA-DESERIAL-001", "Java Insecure Deserialization (XMLDecoder RCE)", r"XMLDecoder\s*\(", 9.8, "CWE-502", "deserialization", "java", "Decoding can call any method", "Use a data-only parser"),
    _sink("JAVA-SQLI-001", "Java SQL Injection via String Concatenation", r"""(?:executeQuery|executeUpdate)\s*\(\s*["'].*\+\s*[a-zA-Z0-9_]+""", 9.0, "CWE-89", "injection", "java", "A query is put together from parts", "Use prepared statements"),
    _sink("PHP-CMD-001", "PHP Command Execution Vulnerability (system/shell_exec)", r"(?:system|shell_exec|passthru|proc_open)\s*\(", 9.5, "CWE-78", "command_execution", "php", "A command line is run", "Use functions of the language instead"),
    _sink("PHP-DESERIAL-001", "PHP Insecure Object Deserialization (unserialize)", r"unserialize\s*\(", 9.0, "CWE-502", "deserialization", "php", "Objects are made from input", "Use JSON"),
    _sink("CPP-BOF-GETS-001", "C/C++ Highly Dangerous Function (gets - Buffer Overflow)", r"\bgets\s*\(", 9.8, "CWE-120", "memory_safety", "c", "A read without a bound", "Use fgets", cased=True),
    _sink("CPP-BOF-STRCPY-001", "C/C++ Insecure Unbounded String Copy (strcpy/strcat Buffer Overflow)", r"\b(?:strcpy|strcat)\s*\(", 8.5, "CWE-120", "memory_safety", "c", "A copy without a bound", "Use bounded copies", cased=True),
    _sink("CPP-FMT-SPRINTF-001", "C/C++ Format String / Buffer Overflow Risk (sprintf)", r"(?<![a-zA-Z0-9_])sprintf\s*\(", 8.0, "CWE-134", "memory_safety", "c", "Formatting without a bound", "Use snprintf", cased=True),
    Rule("MAL-BIN-ARTIFACT-001", "Suspicious Executable Binary / Script Added", "artifact", None, True, "malware", "CRITICAL", 9.5, 0.95, "CWE-506", None, "A compiled binary or executable script among sources.", "Build it from audited sources instead of committing it."),
)
# Severities from least to most severe.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

#: The two patterns with lookbehind, as RE2 (DuckDB) can say them.
RE2 = {"PY-DYN-001": r"(?:^|[^.\w])(?:eval|exec)\s*\(", "CPP-FMT-SPRINTF-001": r"(?:^|[^a-zA-Z0-9_])sprintf\s*\("}


def java_pattern(rule: Rule) -> str:
    """The pattern for Spark: Unicode classes, and Unicode case folding where case doesn't count."""
    return ("(?U)" if rule.cased else "(?iu)(?U)") + rule.pattern


def re2_pattern(rule: Rule) -> str:
    return ("" if rule.cased else "(?i)") + RE2.get(rule.rule_id, rule.pattern)


def by_family(family: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    return [r for r in rules if r.family == family]


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalogue as a table, with its order in `rule_no`. Its size is that of the catalogue, so joins may broadcast it."""
    schema = "rule_no int, rule_id string, title string, family string, pattern string, cased boolean, category string, severity string, score double, confidence double, cwe string, language string, description string, remediation string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], schema)
