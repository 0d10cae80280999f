"""cloakwork: sensitive-data detection, redaction and audit as Spark DataFrame plans."""

__version__ = "0.1.0"
