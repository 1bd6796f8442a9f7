"""patchloom: change-record and text-pair analytics expressed as PySpark DataFrame plans."""
