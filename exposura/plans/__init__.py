"""End-to-end plans and the queries wired into ``__spark_entry__``."""
