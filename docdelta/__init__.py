"""docdelta: comparing and curating document collections as Spark plans."""
