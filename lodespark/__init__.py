"""lodespark: data mining, cleaning and analytics operators as Spark DataFrame plans."""
