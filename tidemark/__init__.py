"""tidemark: did an intervention change a metric?  Answered for many series and panels in one Spark job."""

__version__ = "0.1.0"
