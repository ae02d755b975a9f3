"""ticketlake: receipt text to price facts, as Spark DataFrame jobs."""
