"""tamis: data-subset selection and corpus preparation as Spark DataFrame plans."""
