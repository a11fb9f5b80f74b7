"""opslens: engineering-operations analytics as Spark DataFrame jobs."""
