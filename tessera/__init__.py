"""tessera: everyday data jobs (scrub, align, audit, report, dependency maps, upserts) as Spark DataFrame plans."""

__version__ = "0.1.0"
