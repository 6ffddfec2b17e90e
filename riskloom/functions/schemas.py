"""The schemas that other modules share."""

LOCATION = "struct<file: string, line: int, column: int, end_line: int, end_column: int>"
FINDING = "file string, line int, `column` int, end_line int, end_column int, rule_id string, title string, description string, severity string, confidence double, category string, snippet string, evidence string, language string, remediation string, analyzer string, cwe string, score double, cvss_vector string, cvss_score double, metadata map<string,string>, seq array<int>"
FIELDS = [x.strip().split()[0].strip("`") for x in FINDING.replace("map<string,string>", "map").split(",")]
ROW = ["rule_id", "severity", "type", "description", "score", "confidence", "file", "snippet", "category", "analyzer", "cwe", "remediation", "line", "column", "cvss_vector", "cvss_score", "metadata"]
#: What a syntax tree says of a call; the rest of a finding follows from its rule.
SYNTAX = "line int, `column` int, end_line int, end_column int, rule_id string, title string, description string, severity string, confidence double, category string, snippet string, remediation string, cwe string, score double, seq array<int>"
