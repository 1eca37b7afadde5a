"""rowloom: typed tables with keys, row expiry and MySQL-flavoured changes, as ordinary Spark plans over snapshots."""
