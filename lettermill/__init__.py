"""lettermill: message-archive analytics expressed as Spark DataFrame plans."""
