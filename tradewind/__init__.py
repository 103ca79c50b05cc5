"""Commerce KPIs and issue detection as Spark jobs."""
