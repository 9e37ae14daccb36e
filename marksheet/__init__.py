"""Assignment-grading analytics over whole fleets of runs, as Spark DataFrame jobs."""
