"""siembra: commercial analytics, demand planning and corpus operators as Spark plans."""
