"""The operators as named queries over the generated tables, with the SQL that checks them."""
