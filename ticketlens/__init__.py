"""ticketlens: support-ticket triage and analytics as Spark DataFrame jobs."""
__version__ = "0.1.0"
