"""somatlas: growing self-organizing maps and the data flow around them, on Spark."""
