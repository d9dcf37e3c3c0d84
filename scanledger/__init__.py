"""scanledger: a Spark-native ledger of security-scanner findings.

Scanner reports are ingested as tables, normalised to one findings schema,
fingerprinted, tracked across runs (open / resolved / reopened / suppressed)
and exported per repository -- all as DataFrame jobs.
"""

__version__ = "0.1.0"
TOOL_NAME = "scanledger"
