"""headwater: lineage of SQL script collections as Spark DataFrame jobs."""
